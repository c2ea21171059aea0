"""Chat formatting against comparing lists of turns."""

from ingestctl.llm import chat as C
from ingestctl.llm.catalog import ORACLES, QUERIES
from tests.compare import connect, differences
from tests.conftest import rows

SCHEMA = "conv_id long, turn long, role string, text string, at int, length string"


def frame(spark, turns):
    return spark.createDataFrame([(*t, 1, "l") for t in turns], SCHEMA)


def plain(turns):
    chats, alone = {}, [t for t in turns if t[0] is None]
    for i, (_, turn, role, text) in enumerate(alone):
        chats[("without id", i)] = [(turn is not None, turn or 0, role or "", text or "")]
    for conv, turn, role, text in set(turns) - set(alone):
        chats.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    chats = {c: tuple(t[2:] for t in sorted(ts)) for c, ts in chats.items()}
    result = []
    for turns_of in set(chats.values()):
        holders = [c for c, ts in chats.items() if ts == turns_of]
        if any(len(ts) > len(turns_of) and ts[: len(turns_of)] == turns_of for ts in chats.values()):
            continue
        named = [c for c in holders if not isinstance(c, tuple)]
        text = "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in turns_of)
        result.append((min(named) if named else None, len(turns_of), len(holders), text))
    return sorted(result, key=repr)


def test_against_sql(spark):
    directory = "/root/testdata/sf0.01"
    name = "op6_chat_format"
    assert differences(spark, connect(directory), QUERIES[name], ORACLES[name], directory) is None


def talk(conv, *texts, start=0):
    return [(conv, start + i, "user" if i % 2 == 0 else "assistant", t) for i, t in enumerate(texts)]


def test_snapshots_collapse(spark):
    turns = (
        talk(1, "hi")
        + talk(2, "hi", "hello")
        + talk(3, "hi", "hello", "bye")
        + talk(4, "hi", "hello", "bye")
        + talk(5, "hi", "other")
        + talk(6, "hello")
        + talk(7, "hi", "hello", start=10)
        + talk(8, "hi", "", "bye")
    )
    got = rows(C.format_chats(frame(spark, turns)))
    assert got == plain(turns)
    assert [r[0] for r in got] == [3, 5, 6, 8]


def test_odd_rows(spark):
    turns = [
        *talk(1, "a", "b"),
        *talk(1, "a", "b"),
        (2, None, "user", "first"),
        (2, 0, None, None),
        (2, 0, "", ""),
        (None, 0, "user", "no id"),
        (None, 1, "user", "x" * 300_000),
        *talk(3, *(str(i) for i in range(300))),
        *talk(4, *(str(i) for i in range(299))),
        (5, 0, None, None),
    ]
    collapsed = [t if t[2:] != (None, None) else (*t[:2], "", "") for t in turns]
    assert rows(C.format_chats(frame(spark, turns))) == plain(collapsed)


def test_rows_without_an_id_continue_nothing(spark):
    turns = [*talk(1, "a"), *talk(None, "a", "b"), *talk(None, "a"), *talk(2, "c", "d"), *talk(None, "c")]
    got = rows(C.format_chats(frame(spark, turns)))
    assert got == plain(turns)
    assert [r[:3] for r in got] == [(1, 1, 3), (2, 2, 1), (None, 1, 1)]


def test_many_rows_without_an_id_make_no_window(spark):
    turns = spark.range(20_000).selectExpr("cast(NULL AS long) AS conv_id", "id AS turn", "'user' AS role", "'same' AS text")
    assert [tuple(r)[:3] for r in C.format_chats(turns).collect()] == [(None, 1, 20_000)]


def test_many_copies(spark):
    turns = [t for conv in range(400) for t in talk(conv, "same", "turns")[: 1 + conv % 2]]
    assert rows(C.format_chats(frame(spark, turns)))[0][:3] == (1, 2, 200)


def test_empty_table(spark):
    assert rows(C.format_chats(frame(spark, []))) == []
