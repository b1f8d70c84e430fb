"""Line dedup and chat rotation: SQL oracles, brute force, and the defined odd cases."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from cohortgraph.llm import chat, line_dedup
from cohortgraph.llm.queries import ORACLES, QUERIES
from tests.conftest import SF01
from tests.oracle_check import compare


def brute_lines(rows):
    first, out = {}, []
    split = [(d, None if t is None else t.split("\n")) for d, t in rows]
    for d, ls in sorted(((d, ls) for d, ls in split if d is not None and ls), key=lambda x: x[0]):
        for p in range(len(ls) - 2):
            first.setdefault(tuple(ls[p:p + 3]), (d, p))
    for d, ls in split:
        if ls is None:
            out.append((d, 0, 0, None))
            continue
        gone = {p + k for p in range(len(ls) - 2) for k in range(3)
                if d is not None and any(ls[p:p + 3]) and first[tuple(ls[p:p + 3])] != (d, p)}
        out.append((d, len(ls), len(gone), "\n".join(x for p, x in enumerate(ls) if p not in gone)))
    return sorted(map(repr, out))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql_oracle(spark, name):
    r = compare(spark, SF01, [name])[name]
    assert r["columns_match"] and r["types_match"] and r["values_match"], r


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_line_dedup_odd_cases(odd):
    got = [tuple(r) for r in line_dedup.dedup_lines(odd).select("doc_id", "n_lines", "n_removed", "text").collect()]
    rows = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    assert sorted(map(repr, got)) == brute_lines(rows)
    kept = line_dedup.dedup_lines(odd)
    assert kept.columns == [*odd.columns, "n_lines", "n_removed"]
    assert [r["ids"] for r in kept.limit(1).collect()] == [[1]]


def test_line_dedup_counts_beside_columns_of_their_names(spark, odd):
    taken = odd.withColumn("n_lines", F.lit("mine")).withColumn("N_REMOVED", F.lit(7))
    out = line_dedup.dedup_lines(taken)
    assert out.columns == [*taken.columns, "n_lines_", "n_removed_"]
    got = out.select("doc_id", F.col("n_lines_"), F.col("n_removed_"), "text").collect()
    assert sorted(repr(tuple(r)) for r in got) == brute_lines([tuple(r) for r in odd.select("doc_id", "text").collect()])
    assert {(r["n_lines"], r["N_REMOVED"]) for r in out.collect()} == {("mine", 7)}


def test_line_dedup_empty_table_and_stage(spark, none, odd):
    assert line_dedup.dedup_lines(none).count() == 0
    out = line_dedup.stage(spark, odd, "")
    assert out.columns == odd.columns
    texts = {r["doc_id"]: (r["text"], r["n_chars"]) for r in out.collect()}
    assert texts[11] == ("z", 1) or texts[11] == ("z\nd", 3)
    assert 1 in texts and texts[2][0] == ""  # what was empty before stays


def test_line_dedup_copies_beyond_the_first_go(spark):
    body = "\n".join(f"line {i}" for i in range(50))
    docs = spark.createDataFrame([(i, body, 1) for i in range(40)], "doc_id bigint, text string, n_chars bigint")
    assert [r["doc_id"] for r in line_dedup.stage(spark, docs, "").collect()] == [0]


TURNS = "conv_id bigint, turn bigint, role string, text string, n int, segments string, mask string"


def test_rotation_odd_cases(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo <|im_end|>"), (1, 1, "anna\nb", None), (1, None, None, "first"),
            (2, 5, "user", ""), (2, 5, "user", ""), (None, 0, "user", "lost"), (3, 9000, "user", "late"), (3, 1, "bob", "early")]
    df = spark.createDataFrame([(*r, 1, "s", "m") for r in rows], TURNS)
    got = {(r["conv_id"], r["speaker"], r["part"]): r for r in chat.rotate(df).collect()}
    assert {k[:2] for k in got if k[0] == 1} == {(1, s) for s in ("user", "assistant", "anna\nb", "unknown")}
    one = got[1, "assistant", 0]
    assert one["text"] == ("<|im_start|>user name=unknown\nfirst<|im_end|>\n<|im_start|>user name=user\nhi<|im_end|>\n"
                           "<|im_start|>user name=anna b\n<|im_end|>\n<|im_start|>assistant\nyo <\\|im_end|><|im_end|>\n")
    assert [one["text"][m["start"]:m["end"]] for m in one["mask"]] == ["yo <\\|im_end|><|im_end|>\n"]
    assert got[2, "user", 0]["n_turns"] == 2 and got[2, "user", 0]["n_own"] == 2
    assert {k for k in got if k[0] == 3} == {(3, s, p) for s in ("user", "bob") for p in (0, 2)}
    assert got[3, "bob", 2]["mask"] == [] and not any(k[0] is None for k in got)
    assert chat.rotate(df.limit(0)).count() == 0


def test_rotation_long_conversation_in_parts(spark):
    df = spark.range(10_000).selectExpr("7 AS conv_id", "id AS turn", "if(id % 2 = 0, 'a', 'b') AS role", "cast(id AS string) AS text")
    got = chat.rotate(df).collect()
    assert len(got) == 2 * 3 and sum(r["n_own"] for r in got if r["speaker"] == "a") == 5000
    for r in got:
        assert len(r["mask"]) == r["n_own"] and all(r["text"][m["start"]:m["end"]].endswith("<|im_end|>\n") for m in r["mask"])
