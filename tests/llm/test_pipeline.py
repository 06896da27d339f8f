"""The stages one by one against slow versions, and the whole run."""

import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from pagewright.llm import packing  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
PARTS = {"en": ["the", "ing", "tion", "er", "an"], "de": ["sch", "ung", "heit", "und", "ie"]}


def corpus():
    r = random.Random(12)
    rows = []
    for i in range(240):
        lang = r.choice(list(PARTS))
        rows.append([i, " ".join("".join(r.choices(PARTS[lang], k=r.randint(1, 4))) for _ in range(r.randint(60, 120))), lang, f"src{r.randint(0, 9)}"])
    passage = " ".join(f"p{'abcdefghij'[i % 10]}x{'q' * (i // 10)}" for i in range(60))
    for i in range(0, 200, 10):
        rows[i][1] += " " + passage
    for i in range(200, 220):
        rows[i][1:] = rows[i - 150][1:]  # exact copies
    rows += [[300, None, "en", "src1"], [301, "123 456 %%", "de", None], [302, "", None, "src2"]]
    return [(d, t, x, s, None if t is None else len(t)) for d, t, x, s in rows]


def test_run_equals_the_stages(spark, tmp_path):
    rows = corpus()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        if i < 4:
            assert docs.columns == SCHEMA.replace("long", "").replace("string", "").replace(" ", "").split(",")
            docs.write.parquet(str(tmp_path / f"s{i}"))
            docs = spark.read.parquet(str(tmp_path / f"s{i}"))
        kept.append({r[0]: r for r in docs.collect()})
    language, near, passages, mix, pack = kept
    assert set(language) == {r[0] for r in rows if r[0] < 300}
    assert set(near) == {i for i in range(240) if not 200 <= i < 220}
    words = {}
    first = {}
    for i in sorted(near):
        w = near[i].text.split()
        gone = set()
        for k in range(len(w) - 19):
            if first.setdefault(tuple(w[k : k + 20]), (i, k)) != (i, k):
                gone |= set(range(k, k + 20))
        words[i] = [x for k, x in enumerate(w) if k not in gone]
    assert {i: r.text.split() for i, r in passages.items()} == {i: w for i, w in words.items() if w}
    assert all(r.n_chars == len(r.text) for r in passages.values())
    assert set(mix) <= set(passages) and all(mix[i] == passages[i] for i in mix) and len(mix) > 0.6 * len(passages)
    total = sum(len(w) for w in words.values())
    assert sum(len(words[i]) for i in mix) <= 0.9 * total
    assert set(pack) == set(mix)
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    key = lambda r: (r.doc_id, r.piece, r.length, r.ids_crc32)
    assert sorted(map(key, out)) == sorted(key(r) for r in packing.query(spark.read.parquet(str(tmp_path / "s3"))).collect())


def test_empty_corpus(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_stages_on_odd_rows(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choices(PARTS["en"], k=r.randint(1, 4)))
    text = lambda n: " ".join(word() for _ in range(n))
    plain, long, other = [text(80) for _ in range(30)], text(30_000), text(90)
    rows = [(i, t, "en", "src1") for i, t in enumerate(plain)] + [(100, long, "en", "src0"), (101, f"{long} {text(40)}", None, None)]
    rows += [(None, text(70), None, "src2"), (None, text(75), "en", None), (None, plain[3], "en", "src2"), (None, other, None, None), (None, other, None, None)]
    rows += [(7, plain[7], "en", "src1"), (7, text(60), "en", "src1"), (200, None, "en", "src1"), (201, "", None, None), (202, " \n", "en", "src1"), (203, "1 2 3", "en", "src1")]
    rows = [(d, t, x, s, None if t is None else len(t), i, "x") for i, (d, t, x, s) in enumerate(rows)]
    docs = spark.createDataFrame(rows, SCHEMA + ", _id int, c string").repartition(4)
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, "")
        assert out.schema == docs.schema
        kept[name] = out.collect()
        assert len({x._id for x in kept[name]}) == len(kept[name])
        docs = spark.createDataFrame(kept[name], docs.schema).repartition(3)
    language, near, passages, mix = kept.values()
    gone = {x[5] for x in rows} - {x._id for x in language}
    assert {rows[i][0] for i in gone} <= {200, 201, 202, 203} and 200 not in {x.doc_id for x in language}
    # of equal texts one row stays, of the two long ones the first; rows without ids sort first
    texts = [x.text for x in near]
    assert len(set(texts)) == len(texts) and set(texts) == {x.text for x in language} - {rows[31][1]}
    assert [x.doc_id for x in near if x.text in (plain[3], plain[7], other, long)].count(None) == 2
    assert {x.text for x in passages} == set(texts) and {x._id for x in mix} <= {x._id for x in passages}
    assert len(corpus_pipeline.STAGES[4][1](spark, docs, "").collect()) >= len(mix)
