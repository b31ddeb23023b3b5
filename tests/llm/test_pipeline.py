"""The pipeline: every stage on its own input against brute force, odd documents, columns of any name."""

import zlib
from collections import Counter

import corpus_pipeline
import duckdb
import numpy as np
import pyarrow as pa
import pytest
from nearfield.llm import catalogue, common, jaccard, langid, linededup, packing
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def steps(spark):
    """The documents before the first stage and after each but the last."""
    found = [spark.read.parquet(f"{DATA}/documents.parquet")]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        found.append(common.stored(stage(spark, found[-1], DATA)))
    return found


def rows(df):
    return sorted(tuple(x) for x in df.collect())


def test_stages_are_those_named():
    assert list(STAGES) == ["language", "lines", "near", "mix", "pack"] and corpus_pipeline.ORACLE_SQL is None


def test_language(steps):
    model = langid.fit(steps[0])
    predicted = ((x, model.predict(x["text"])) for x in steps[0].collect())
    kept = [tuple(x) for x, (lang, _, _, foreign, _) in predicted if lang != langid.UNKNOWN and not foreign]
    assert rows(steps[1]) == sorted(kept) and len(kept) > 150


def without_later_copies(docs, least):
    """Texts in order of doc_id, without the lines of windows of at least so many words that stood before."""
    seen, out = set(), {}
    for doc_id, text in docs:
        every = text.split("\n")
        lines = [(i, x.strip(" \t\r\x0b\x0c")) for i, x in enumerate(every)]
        lines = [(i, x) for i, x in lines if x]
        words, gone, new = [len(x.split()) for _, x in lines], set(), []
        for a in range(len(lines)):
            total = 0
            for b in range(a, len(lines)):
                total += words[b]
                if total >= least:
                    key = tuple(x for _, x in lines[a : b + 1])
                    if key in seen:
                        gone.update(range(lines[a][0], lines[b][0] + 1))
                    seen.add(key)
        # blank lines between two that go, go too
        marks = sorted(gone)
        for a, b in zip(marks, marks[1:]):
            if all(not x.strip() for x in every[a + 1 : b]):
                gone.update(range(a, b))
        out[doc_id] = "\n".join(x for i, x in enumerate(every) if i not in gone) if gone else text
    return out


def test_lines(steps):
    before = {x["doc_id"]: x for x in steps[1].collect()}
    assert len(before) == steps[1].count()
    wanted = without_later_copies(sorted((d, x["text"]) for d, x in before.items()), linededup.MIN_WORDS)
    wanted = {d: t for d, t in wanted.items() if t == before[d]["text"] or t.strip()}
    after = {x["doc_id"]: x for x in steps[2].collect()}
    assert {d: x["text"] for d, x in after.items()} == wanted and len(wanted) < len(before)
    for d, x in after.items():
        assert x["n_chars"] == (len(x["text"]) if x["text"] != before[d]["text"] else before[d]["n_chars"]) and x["lang"] == before[d]["lang"]


def test_near(steps):
    docs = sorted((x["doc_id"], x["text"]) for x in steps[2].collect())
    sets, root = [set(jaccard.shingles(t).tolist()) for _, t in docs], list(range(len(docs)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and len(a & sets[j]) >= jaccard.SIMILARITY * len(a | sets[j]):
                x, y = sorted((top(i), top(j)))
                root[y] = x
    kept = {docs[i][0] for i in range(len(docs)) if top(i) == i}
    assert rows(steps[3]) == sorted(tuple(x) for x in steps[2].collect() if x["doc_id"] in kept)


def test_mix(steps, tmp_path):
    steps[3].write.parquet(f"{tmp_path}/documents")
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents/*.parquet'")
    wanted = {d: taken // size for d, size, taken in duck.sql(f"SELECT doc_id, size, taken FROM ({catalogue.OP1_SQL})").fetchall() if taken}
    got = steps[4].collect()
    assert Counter(x["doc_id"] for x in got) == wanted and steps[4].columns == steps[0].columns
    before = {x["doc_id"]: tuple(x) for x in steps[3].collect()}
    assert all(tuple(x) == before[x["doc_id"]] for x in got)


def test_pack(spark, steps):
    from tokenizers import Tokenizer

    model, wanted = Tokenizer.from_file(packing.tokenizer_path()), []
    for x in steps[4].collect():
        ids = model.encode(x["text"] or "", add_special_tokens=False).ids + [2]
        first = len(ids) % 1024 or 1024
        cuts = [0] if len(ids) <= 1024 else [0, *range(first, len(ids), 1024)]
        for i, (a, b) in enumerate(zip(cuts, [*cuts[1:], len(ids)])):
            wanted.append((x["doc_id"], i, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    got = STAGES["pack"](spark, steps[4], DATA).collect()
    assert sorted(tuple(x)[:5] for x in got) == sorted(wanted)
    ends = {}
    for x in sorted(got, key=lambda x: (x["sequence_id"], x["offset"])):
        assert x["offset"] == ends.get(x["sequence_id"], 0)
        ends[x["sequence_id"]] = x["offset"] + x["length"]
    assert max(ends.values()) <= 1024


def test_run_is_all_stages(spark, steps):
    got = corpus_pipeline.run(spark, DATA)
    assert sorted(tuple(x)[:5] for x in got.collect()) == sorted(tuple(x)[:5] for x in STAGES["pack"](spark, steps[4], DATA).collect())


NAMES = ["a b", "x`y", "select", "row", "key", "new", "spans", "n_lines", "removed", "lang_pred", "score", "foreign", "row_key", "group", "best", "own", "position", "use", "size", "target", "bucket", "start", "rank", "_0", "_text", "_id", "_maybe", "_word", "word"]
ODD = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (3, "  \n\n \t", "en", None, 5), (4, "one", "en", "a", 3), (4, "one", "en", "a", 3), (4, "another text", "fr", "b", 12),
    (None, "no id here at all", None, "b", 17), (None, "no id here at all", None, "b", 17), (5, "word " * 30000, "en", "b", 150000), (6, "12.5 ... 99 !!", "de", "c", 14), (7, "1" * 20000, "de", "c", 20000),
]


@pytest.fixture(scope="module")
def odd(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join("`" + c.replace("`", "``") + "` string" for c in NAMES)
    return spark.createDataFrame([(*x, *NAMES) for x in ODD], schema)


@pytest.mark.parametrize("name", [n for n in STAGES if n != "pack"])
def test_stages_with_odd_documents_and_names(spark, odd, name):
    got = STAGES[name](spark, odd, DATA)
    assert got.columns == odd.columns and got.dtypes == odd.dtypes
    kept = got.collect()
    assert kept and all([x[c] for c in NAMES] == NAMES for x in kept)
    assert STAGES[name](spark, odd.limit(0), DATA).collect() == []


def test_odd_documents_by_stage(spark, odd):
    texts = lambda name: Counter((x["doc_id"], x["text"]) for x in STAGES[name](spark, odd, DATA).collect())
    given = Counter((d, t) for d, t, *_ in ODD)
    assert all(t and any(c.isalpha() for c in t) for _, t in texts("language"))
    assert texts("lines") == given
    # copies go; texts without words stay
    assert texts("near") == Counter(dict.fromkeys(given, 1))
    mixed = texts("mix")
    assert set(mixed) == {(d, t) for d, t in given if t and t.split()} and all(n <= 2 * given[k] for k, n in mixed.items())


def test_pack_of_odd_documents(spark, odd):
    got = STAGES["pack"](spark, odd, DATA).collect()
    assert Counter(x["doc_id"] for x in got if x["piece"] == 0) == Counter(d for d, *_ in ODD)
    assert STAGES["pack"](spark, odd.limit(0), DATA).collect() == []


def test_near_starts_no_second_set_of_workers(spark, odd, monkeypatch):
    def fail(*args, **options):
        raise AssertionError("rows of a Python list go through Python workers of their own")

    given = odd.limit(20)
    monkeypatch.setattr(type(spark), "createDataFrame", fail)
    assert STAGES["near"](spark, given, DATA).count()


@pytest.mark.parametrize("name", ["language", "lines", "near", "pack"])
def test_workers_get_small_batches(spark, odd, name):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    key, text = "spark.sql.execution.arrow.maxBytesPerBatch", F.repeat(F.lit("x"), 1 << 20)
    large = spark.range(0, 12, 1, 1).select(text.alias("text"))
    given = spark.conf.get(key, None)
    try:
        spark.conf.unset(key)
        STAGES[name](spark, odd, DATA)
        got = [x["n"] for x in large.mapInArrow(sizes, "n long").collect()]
        assert sum(got) == 12 and max(got) <= 3
        # a session's own bound stays
        spark.conf.set(key, "12345678")
        STAGES[name](spark, odd, DATA)
        assert spark.conf.get(key) == "12345678"
    finally:
        spark.conf.unset(key)
        if given is not None:
            spark.conf.set(key, given)
