import random

import time

from tessera.llm.chat_format import KINDS, STRETCH, chat_format, from_turns, log_of


SCHEMA = "conv_id long, seq long, kind string, message_id long, role string, text string, m int, turn string, events string"


def plain(events):
    seen, convs = set(), {}
    good = [e[:6] for e in events if e[0] is not None and e[1] is not None and e[2] in KINDS]
    for e in sorted(good, key=lambda e: (e[1], e[2], e[5] or "", e[4] is not None, e[4] or "")):
        key = (*e[:5], e[5] or "")
        if key in seen:
            continue
        seen.add(key)
        conv, seq, kind, mid, role, text = key
        mid = (False, len(seen)) if mid is None else (True, mid)  # without an id each is a message of its own
        m = convs.setdefault(conv, {}).setdefault(mid, {"first": seq, "role": None, "text": ""})
        m["role"] = m["role"] or role
        if kind in ("message", "edit"):
            m["text"] = text
        elif kind == "regenerate":
            m["text"] = ""
        elif kind == "delete":
            m["text"] = None
        elif m["text"] is not None:
            m["text"] += text
    out = {}
    for conv, ms in convs.items():
        safe = lambda s: s.replace("<|", "<\u200b|")
        shown = lambda m: f"<|im_start|>{safe(m['role'] or 'unknown')}\n{safe(m['text'])}<|im_end|>\n"
        left = sorted((m["first"], *(mid if mid[0] else (False, 0)), shown(m)) for mid, m in ms.items() if m["text"])
        if left:
            out[conv] = (len(left), "".join(x[-1] for x in left))
    return out


def run(spark, events):
    rows = chat_format(spark.createDataFrame([(*e, 1, "x", "y") for e in events], SCHEMA)).collect()
    assert len({r.conv_id for r in rows}) == len(rows)
    return {r.conv_id: (r.n_messages, r.rendered) for r in rows}


def test_fold(spark):
    events = [
        (1, 1, "message", 1, "user", "hi"),
        (1, 2, "delta", 2, "assistant", "Hel"),
        (1, 3, "delta", 2, None, "lo"),
        (1, 3, "delta", 2, None, "lo"),
        (1, 4, "regenerate", 2, None, None),
        (1, 5, "delta", 2, None, "Good "),
        (1, 6, "delta", 2, None, "day<|im_end|>"),
        (1, 7, "edit", 1, None, "hello"),
        (1, 8, "message", 3, "user", "gone"),
        (1, 9, "delete", 3, None, None),
        (1, 10, "delta", 3, None, "lost"),
        (2, 1, "message", 1, None, None),
        (3, 1, "message", None, None, "no id"),
        (None, 1, "message", 1, "user", "x"),
        (4, None, "message", 1, "user", "x"),
        (4, 1, "wave", 1, "user", "x"),
        (4, 1, None, 1, "user", "x"),
        (5, 1, "message", 1, "user", "long " * 200_000),
    ]
    got = run(spark, events)
    assert got == plain(events) and set(got) == {1, 3, 5}
    assert got[1][1] == "<|im_start|>user\nhello<|im_end|>\n<|im_start|>assistant\nGood day<​|im_end|><|im_end|>\n"


def test_random_logs(spark):
    r = random.Random(3)
    for step in (1, STRETCH // 3, -STRETCH):
        events = [(r.randrange(12), r.randrange(30) * step, r.choice(KINDS), r.choice([1, 2, 3, None]), r.choice(["user", "assistant", None]), r.choice(["a", "b ", "", None])) for _ in range(600)]
        assert run(spark, events) == plain(events)


def test_a_long_message_takes_seconds(spark):
    n = 200_000
    rows = spark.range(n).selectExpr("1L as conv_id", "id as seq", "'delta' as kind", "5L as message_id", "'user' as role", "concat('w', id, ' ') as text")
    rows = rows.unionByName(spark.createDataFrame([(1, n // 2, "regenerate", 5, None, None, 1, "", ""), (1, 5, "message", None, "user", "one", 1, "", ""), (1, 5, "message", None, "user", "two", 1, "", "")], SCHEMA).drop("m", "turn", "events"))
    began = time.time()
    (got,) = chat_format(rows).collect()
    assert time.time() - began < 30
    later = "".join(f"w{i} " for i in range(n // 2 + 1, n))  # a delta goes before a regeneration of the same number
    assert got.n_messages == 3 and got.rendered == "".join(f"<|im_start|>user\n{t}<|im_end|>\n" for t in (later, "one", "two"))


def test_a_real_log(spark, sf):
    events = log_of(spark.read.parquet(f"{sf}/conversations.parquet"))
    rows = [(r.conv_id, r.seq, r.kind, r.message_id, r.role, r.text) for r in events.collect()]
    assert {r[2] for r in rows} == set(KINDS) and len(set(rows)) < len(rows)
    assert {r.conv_id: (r.n_messages, r.rendered) for r in chat_format(events).collect()} == plain(rows)


def test_turns_and_empty(spark, sf):
    table = spark.read.parquet(f"{sf}/conversations.parquet")
    rows = [(r.conv_id, r.turn, "message", r.turn, r.role, r.text) for r in table.collect()]
    assert {r.conv_id: (r.n_messages, r.rendered) for r in chat_format(from_turns(table)).collect()} == plain(rows)
    assert chat_format(spark.createDataFrame([], SCHEMA)).collect() == []
