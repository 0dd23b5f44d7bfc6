"""The pipeline against a plain walk over a few documents with planted cases."""

import random

import pytest

import corpus_pipeline as cp

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, stem):
    return " ".join(f"{stem}{rng.randrange(5000)}" for _ in range(n))


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    rng = random.Random(9)
    rows = {i: words(rng, rng.randint(60, 120), "w") for i in range(40)}
    item = words(rng, 30, "q")
    passage = words(rng, 60, "p")
    rows[50] = rows[3]  # exact copy
    rows[51] = " ".join(rows[4].split()[:-1] + ["changed"])  # near copy
    rows[52] = rows[5] + " " + passage
    rows[53] = passage + " " + words(rng, 80, "w")  # loses the passage
    rows[54] = words(rng, 40, "w") + " " + " ".join(item.split()[5:20]) + " end"  # contaminated
    rows[55], rows[56], rows[57] = None, "", "12 34 !!"  # no language
    table = [(i, t, "en" if i % 3 else None, f"s{i % 4}", len(t or "")) for i, t in rows.items()]
    table += [(7, rows[7], "en", "s3", len(rows[7]))]  # a row repeated in every value
    folder = tmp_path_factory.mktemp("planted")
    docs = spark.createDataFrame(table, SCHEMA)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([("b1", item)], "item_id string, text string").write.parquet(
        f"{folder}/benchmark.parquet"
    )
    return str(folder), rows, passage


def test_planted_cases(spark, planted):
    folder, rows, passage = planted
    out = {}
    for r in cp.run(spark, folder).collect():
        assert r.doc_id not in out
        out[r.doc_id] = r
    # 52 holds all of 5 and is no near copy of it
    assert set(out) == set(range(40)) | {52, 53}
    for i in range(40):
        assert out[i].text == rows[i] and out[i].n_chars == len(rows[i])
    assert passage in out[52].text
    assert passage not in out[53].text and out[53].text.strip() in rows[53]
    sizes = {}
    for r in out.values():
        assert r.n_words == len(r.text.split()) and 0 <= r.taken <= 3 * r.n_words
        sizes.setdefault(r.source, []).append(r.taken)
        assert r.source_size == sum(o.n_words for o in out.values() if o.source == r.source)
    for source, taken in sizes.items():
        target = next(r.target for r in out.values() if r.source == source)
        assert abs(sum(taken) - target) <= 0.5 + 1e-6


def test_stages_keep_columns_nulls_and_empty_tables(spark, planted):
    folder, _, _ = planted
    rows = [(1, "words of a text here", "en", None, None, "x", 5), (None, None, None, None, None, None, None),
            (2, "", "en", "a", 0, "y", 6), (1, "words of a text here", "en", None, None, "x", 5)]
    docs = spark.createDataFrame(rows, SCHEMA + ", asset_id string, batch int")
    for _, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.schema.names == docs.schema.names
        assert out.count() <= 4
        assert stage(spark, docs.limit(0), folder).count() == 0
    last = cp.STAGES[-1][1](spark, docs, folder)
    assert last.count() == 4 and set(docs.columns) <= set(last.columns)
    assert [n for n, _ in cp.STAGES] == [
        "language_id", "ngram_join", "suffix_dedup", "decontamination", "mixing"
    ]


def test_no_language_to_learn(spark, planted):
    rows = [(1, "words of a text", None, "a", 15), (2, "12 !!", None, "a", 5), (3, None, None, "a", 0)]
    out = cp.language(spark, spark.createDataFrame(rows, SCHEMA), planted[0])
    assert [r.doc_id for r in out.collect()] == [1]


def test_only_split_characters_go(spark, planted):
    """U+FFFD of the input stays, also beside a cut; of é, ê and 😀, 😁 one byte differs."""
    rng = random.Random(3)
    a, b = words(rng, 20, "a"), words(rng, 20, "b")
    rows = [(1, f"é{a}é ", "en", "s", 0), (2, f"1�ê{a}ê�2", "en", "s", 0)]
    rows += [(3, f"😀{b}😀 ", "en", "s", 0), (4, f"x{b}😁�y{a}�z", "en", "s", 0)]
    out = cp.repeated_passages(spark, spark.createDataFrame(rows, SCHEMA), planted[0])
    text = {r.doc_id: r.text for r in out.collect()}
    assert text == {1: rows[0][1], 2: "1�ê�2", 3: rows[2][1], 4: "x�y�z"}
