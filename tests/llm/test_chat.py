"""Event logs against a fold one by one, the template against odd texts, the query against its SQL."""

from collections import defaultdict
from hashlib import sha256

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from growthpanel.llm import chat
from growthpanel.llm.queries import ORACLE, QUERIES
from tests.compare import difference, open_tables

ODD = ["", "\\", "<", "</turn>\n", "\\l\\s<\\", "<turn user>hi</turn>\n", "é😀\n\n", " ", "a>b", "\\### Assistant: </turn> ok", "\\\\s", "x" * 3000, None]
EVENTS = "conv_id long, seq long, kind string, turn long, role string, text string"


def fold(events):
    """{(conv_id, turn): (role, text)} by one event after another."""
    state = defaultdict(dict)
    low = lambda v: (v is not None, v if v is not None else 0)
    word = lambda v: (v is not None, (v or "").encode())
    for conv, _, kind, turn, role, text in sorted(events, key=lambda e: (low(e[1]), e[2], e[3], word(e[4]), word(e[5]))):
        turns, text = state[conv], text or ""
        before = turns.get(turn, (None, ""))
        turns[turn] = (role or before[0], before[1] + text if kind == "delta" else "" if kind == "regenerate" else text)
        if kind in ("edit", "regenerate"):
            for later in [t for t in turns if t > turn]:
                del turns[later]
    return {(c, t): m for c, turns in state.items() for t, m in turns.items()}


def test_logs_fold_like_one_event_after_another(spark):
    rng = np.random.default_rng(3)
    events = []
    for conv in range(60):
        for seq in range(rng.integers(1, 30)):
            kind = rng.choice(["message", "delta", "delta", "delta", "edit", "regenerate"])
            text = None if kind == "regenerate" else str(rng.choice(["a", "b ", "<c", "\\", ""]))
            role = str(rng.choice(["user", "assistant"])) if kind == "message" else None
            events.append((conv if conv else None, int(seq // rng.integers(1, 3)), str(kind), int(rng.integers(0, 5)), role, text))
    found = chat.final_messages(spark.createDataFrame(events, EVENTS).repartition(4)).collect()
    # a regenerate's null text is empty, like any other
    assert {(r.conv_id, r.turn): (r.role, r.text) for r in found} == fold(events)
    assert len(found) == len({(r.conv_id, r.turn) for r in found})


def test_streamed_edited_and_regenerated_answers(spark):
    log = [
        (1, 1, "message", 0, "user", "Hi"),
        (1, 2, "message", 1, "assistant", None),
        (1, 3, "delta", 1, None, "Hel"),
        (1, 4, "delta", 1, None, "lo"),
        (1, 5, "message", 2, "user", "More"),
        (1, 6, "regenerate", 1, None, None),
        (1, 7, "delta", 1, None, "Good "),
        (1, 8, "delta", 1, None, "day"),
        (2, 1, "message", 0, "user", "a"),
        (2, 2, "message", 1, "assistant", "b"),
        (2, 3, "edit", 0, None, "A"),
    ]
    out = chat.format_messages(chat.final_messages(spark.createDataFrame(log, EVENTS)))
    assert {r.conv_id: r.formatted for r in out.collect()} == {
        1: "<turn user>Hi</turn>\n<turn assistant>Good day</turn>\n",
        2: "<turn user>A</turn>\n",
    }


def test_unknown_kinds_are_refused(spark):
    with pytest.raises(PySparkException):
        chat.final_messages(spark.createDataFrame([(1, 1, "deleted", 0, "user", "Hi")], EVENTS)).collect()


def test_anything_reads_back(spark):
    rows = [(i, t, role, text) for i, role in enumerate(["user", "assistant", "a>b\n<\\", "", None]) for t, text in enumerate(ODD)]
    messages = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for r in chat.read_formatted(chat.format_messages(messages)).collect():
        mine = [(m[2] or "", m[3] or "") for m in rows if m[0] == r.conv_id]
        assert [tuple(m) for m in r.messages] == mine
        assert list(r.learned) == [text for role, text in mine if role == "assistant"]
        assert r.formatted.count("<") == 2 * len(mine)


def brute(rows):
    groups = defaultdict(list)
    for conv, turn, role, text in rows + [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]:
        groups[conv].append(((turn is not None, turn or 0, role is not None, (role or "").encode(), text is not None, (text or "").encode()), role or "", text or ""))
    out = {}
    for conv, turns in groups.items():
        turns.sort()
        said = "".join(f"{role}\n{text}\n" for _, role, text in turns)
        loss = "".join(text for _, role, text in turns if role == "assistant")
        out[conv] = (len(turns), sha256(said.encode()).hexdigest(), len(loss), sha256(loss.encode()).hexdigest())
    return out


def digests(df):
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in df.collect()}


def test_chat_equals_its_sql(spark, folder):
    assert difference(QUERIES["op11_chat"](spark, folder), open_tables(folder), ORACLE["op11_chat"]) is None


def test_given_odd_and_empty_conversations(spark, folder):
    given = spark.read.parquet(f"{folder}/conversations.parquet")
    assert digests(chat.chat_digest(given)) == brute([tuple(r) for r in given.select("conv_id", "turn", "role", "text").collect()])
    rows = [(c, t, role, text) for c in (1, None) for t in (0, 1, None) for role in ("assistant", None, "system") for text in ODD] * 2
    odd = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, place string, loss int")
    assert digests(chat.chat_digest(odd.repartition(3))) == brute(rows)
    assert digests(chat.chat_digest(odd.limit(0))) == brute([])


def test_only_dataframe_functions(spark, folder):
    plan = QUERIES["op11_chat"](spark, folder)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas", "MapPartitions", "ExistingRDD"))
    assert QUERIES["op11_chat"](spark, folder).select(F.sum("n_turns")).first()[0] == 2 + spark.read.parquet(f"{folder}/conversations.parquet").count()
