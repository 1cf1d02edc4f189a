"""The mix against DuckDB, and its laws."""

import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from gridtally.llm import mixing

ROWS = (
    [(i, f"s{i % 4}", "w " * (37 * i % 211)) for i in range(120)]
    + [(1000 + i, "hot", "a b c\td\n" * (i % 9)) for i in range(80)]
    + [(2000, None, "no source here"), (2001, "s1", None), (2002, "s1", ""), (5, "s1", "twice same"), (5, "s1", "twice same")]
    + [(3000, "tiny", "one two three"), (3001, "é", "accented " * 40), (3002, "long", "word " * 20_000)]
)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, source string, text string")


@pytest.fixture(scope="module")
def report(docs):
    return mixing.mix_report(docs).toPandas()


def test_equals_oracle(docs, report):
    db = duckdb.connect()
    documents = docs.toPandas()  # noqa: F841
    columns = ["doc_id", "size", "source_size", "target", "taken", "first_shard"]
    theirs = db.execute(f"SELECT {', '.join(columns)} FROM ({mixing.report_sql()})").fetchall()
    ours = [tuple(r)[:5] + (None if r[5] != r[5] else int(r[5]),) for r in report[columns].itertuples(index=False)]
    assert sorted(map(repr, ours)) == sorted(map(repr, theirs))


def test_laws(report):
    assert len(report) == len(ROWS)
    assert (report.taken <= 3 * report["size"]).all()
    by_source = report.groupby(["source_size", "target"]).agg(taken=("taken", "sum"), size=("size", "sum"))
    for (size, target), row in by_source.iterrows():
        sources = round(row["size"] / size) if size else 1  # sources that are alike
        assert abs(row["taken"] - sources * target) <= 2 * sources * mixing.BLOCK_WORDS


def test_rerun_agrees(docs, report):
    again = mixing.mix_report(docs.repartition(7)).toPandas()
    key = ["doc_id", "size", "taken"]
    assert sorted(map(tuple, again[key].values.tolist())) == sorted(map(tuple, report[key].values.tolist()))


@pytest.mark.parametrize("n", [1, 2, 3, 17, 256, 1000])
def test_permutation(spark, n):
    df = spark.range(n).select(
        mixing.permuted(
            F.col("id"), F.lit(n).cast("long"), mixing.permutation(F.lit(n).cast("long"), F.lit(5).cast("long"), 1)
        ).alias("p")
    )
    places = [r[0] for r in df.collect()]
    assert sorted(places) == list(range(n))
    if n > 100:
        assert sum(p == i for i, p in enumerate(places)) < 10


def test_shards_hold_the_mix(docs, report):
    mix = mixing.Mix(docs, shard_slots=16)
    assert mix.shards().agg(F.sum("n_words")).first()[0] == report.taken.sum()
    counts = mix.counts.toPandas()
    per_shard = counts.groupby("shard").n.sum().sort_index()
    assert set(per_shard[:-1]) == {16} and len(per_shard) > 20
    goals = {r["source_key"]: r["n_slots"] for r in mix.sources.where("n_slots > 0").collect()}
    assert counts.groupby("source_key").n.sum().to_dict() == goals
    share = max(goals.values()) / sum(goals.values())  # the variance of a multinomial count
    most = counts[counts.source_key == max(goals, key=goals.get)].set_index("shard").n.reindex(per_shard.index[:-1], fill_value=0)
    assert 0.5 < most.var() / (16 * share * (1 - share)) < 1.6


def test_every_slot_is_filled_once(docs):
    mix = mixing.Mix(docs, shard_slots=16)
    slots = mix.slots.toPandas()
    counted = slots.groupby(["source_key", "shard"]).size()
    drawn = mix.counts.toPandas().set_index(["source_key", "shard"]).n
    assert counted.sort_index().to_dict() == drawn.sort_index().to_dict()
    assert not slots.duplicated(["source_key", "epoch", "block"]).any()


def test_the_query_holds_the_draw(docs):
    """Taken words come from the drawn counts: their table is among what the plan reads."""
    assert any("mix-counts" in f for f in mixing.mix_report(docs).inputFiles())
    assert any("mix-counts" in f for f in mixing.mixed_documents(docs, 32).inputFiles())


def test_documents_follow_the_report(docs, report):
    clash = docs.withColumns({c: F.lit(c) for c in ("parts", "turn", "size", "_copy", "text_hash", "_take")})
    taken = mixing.mixed_documents(clash, mixing.BLOCK_WORDS)
    assert taken.columns == clash.columns and taken.where("parts <> 'parts' OR turn <> 'turn'").count() == 0
    words = taken.select(F.regexp_count("text", F.lit(r"\S+")).alias("n")).agg(F.sum("n")).first()[0]
    assert words == report.taken.sum()


def test_documents_equal_the_shards(docs):
    """Every text of the mix, rebuilt from the slots' rows, equal rows of a null doc_id among them."""
    same = docs.sparkSession.range(700).selectExpr(
        "CAST(NULL AS BIGINT) AS doc_id", "'crowd' AS source", "repeat('a b c d e ', 30) AS text"
    )
    some = docs.select("doc_id", "source", "text").limit(150).unionByName(same)
    whole = some.select("doc_id", "source", "text", F.create_map(F.lit("id"), "doc_id").alias("held"))
    texts = {(r.row_key, r.text_key): r.text for r in some.select(*mixing.row_keys(), "text").collect()}
    rows = mixing.Mix(whole, 32).shards().toPandas()
    expected = Counter()
    for (*_, epoch), own in rows.groupby(["source_key", "first_word", "epoch"]):
        text = texts[own.row_key.iloc[0], own.text_key.iloc[0]]
        if own.n_words.sum() < own["size"].iloc[0]:
            words = re.findall(r"[^\x20\x09-\x0D]+", text)
            parts = sorted(zip(own.from_word, own.n_words))
            text = " ".join(" ".join(words[a : a + n]) for a, n in parts)
        expected[text] += 1
    found = Counter(r["text"] for r in mixing.mixed_documents(whole, 32).select("text").collect())
    assert found == expected and sum(n for t, n in expected.items() if t.startswith("a b c")) > 100


def test_empty(spark, docs):
    none = docs.limit(0)
    assert mixing.mix_report(none).count() == 0 and mixing.mixed_documents(none, 32).count() == 0
    blank = spark.createDataFrame([(1, "s", None), (2, None, " ")], "doc_id long, source string, text string")
    assert [r["taken"] for r in mixing.mix_report(blank).collect()] == [0, 0]


def test_targets_by_hand(spark):
    rows = [(1, "a", "w " * 10), (2, "b", "w " * 100), (3, "c", "w " * 190)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    found = {r["doc_id"]: r["target"] for r in mixing.mix_report(df, block_words=1).collect()}
    # 300 words by 1, 2, 3: a stops at 30, the other 270 go 2 to 3
    assert found == pytest.approx({1: 30.0, 2: 108.0, 3: 162.0})
