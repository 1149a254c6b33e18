"""Queries of the text operators against DuckDB, and the pipeline's stages against what they must keep."""

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from braidlog.llm.queries import ORACLES, QUERIES  # noqa: E402
from conftest import same  # noqa: E402


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, sf_dir, duck, name):
    same(QUERIES[name](spark, sf_dir), duck.execute(ORACLES[name]))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_one_row_or_more_for_each_document(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    assert df.select("doc_id").distinct().count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()


def test_pipeline(spark, sf_dir):
    import corpus_pipeline
    from braidlog.functions.runtime import written

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
        sizes.append(docs.count())
        assert name == corpus_pipeline.STAGES[-1][0] or docs.columns == columns
    assert sizes[0] > sizes[1] > sizes[2] >= sizes[3] == sizes[4]
    assert docs.select("doc_id").distinct().count() == sizes[4]
    whole = corpus_pipeline.run(spark, sf_dir)
    assert whole.select("doc_id").distinct().count() == sizes[4]
    assert corpus_pipeline.ORACLE_SQL is None


def test_stages_equal_plain_python(spark, tmp_path):
    """Every stage over rows with nulls, repeats, ties and clashing columns, held against plain Python."""
    import random
    import re
    import zlib

    import corpus_pipeline
    import numpy as np
    import plain
    from braidlog.llm import pii
    from tokenizers import Tokenizer

    rnd = random.Random(11)
    prose = lambda n: " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 7))) for _ in range(n)) + "."
    base, other = prose(60), prose(40)
    texts = [prose(rnd.randint(5, 80)) for _ in range(25)] + [base, base, base + " end", base.replace(" ", "\n", 3), other, other + " x", None, "", "few words", prose(30) + "\nhome | about | news | contact"]
    texts += [f"{prose(20)} card 4785380592391139 and {prose(5)}", f"{prose(20)} ip 227.5.221.1 ssn 123-45-6789 {prose(5)}", f"{prose(20)} born 1999-02-28 {prose(3000)}", "buy!! now!! " * 9]
    rows = [(i, t, None, "s", None if t is None else len(t), "a", 1) for i, t in enumerate(texts)]
    rows += [rows[25], rows[3], (None, base, "en", "s", 1, "b", 2), (None, prose(30), "en", None, None, "c", 3), (7, prose(25), "x", "s", 2, "d", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, q_text string, found int")
    folder = f"{tmp_path}/documents.parquet"
    df.repartition(3).write.parquet(folder)
    spark.conf.set(pii.KEY_SETTING, plain.KEY)
    try:
        stage, kept = dict(corpus_pipeline.STAGES), spark.read.parquet(folder)
        seen = lambda d: sorted([tuple(r) for r in d.select("doc_id", "text", "n_chars", "q_text", "found").collect()], key=repr)

        want = [(i, t, len(t), q, f) for i, o, _, _, _, q, f in rows if (t := plain.cleaned(o)) is not None]
        now = stage["quality_rules"](spark, kept, str(tmp_path))
        assert now.columns == df.columns and seen(now) == sorted(want, key=repr)
        now.write.parquet(f"{tmp_path}/1")

        groups: dict = {}
        for r in want:
            groups.setdefault(re.sub("[\\x20\\x09-\\x0d]", "", r[1]), []).append(r)
        best = {bare: min((-len(r[1]), r[0] is None, r[0] or 0) for r in g) for bare, g in groups.items()}
        now = stage["exact_dedup"](spark, spark.read.parquet(f"{tmp_path}/1"), str(tmp_path))
        got = seen(now)
        assert sorted((-len(r[1]), r[0] is None, r[0] or 0) for r in got) == sorted(best.values()) and set(got) <= set(want)
        now.write.parquet(f"{tmp_path}/2")

        found = plain.brute_components(list(enumerate(r[1] for r in got)), 5, 80, 100)
        classes: dict = {}
        for k, r in enumerate(got):
            classes.setdefault(found[k][1], []).append((r[0] is None, r[0] or 0))
        now = stage["near_dedup"](spark, spark.read.parquet(f"{tmp_path}/2"), str(tmp_path))
        near = seen(now)
        assert sorted((r[0] is None, r[0] or 0) for r in near) == sorted(min(c) for c in classes.values()) and set(near) <= set(got) and len(near) < len(got)
        now.write.parquet(f"{tmp_path}/3")

        def hidden(text):
            text = re.sub(r"(?<=card )\d{16}", lambda m: plain.card(m[0]), text)
            text = re.sub(r"(?<=ip )[\d.]+(?= ssn)", lambda m: plain.address(m[0]), text)
            text = re.sub(r"(?<=ssn )[\d-]+", lambda m: plain.social(m[0]), text)
            return re.sub(r"(?<=born )[\d-]+", lambda m: plain.day(m[0]), text)

        now = stage["private_data"](spark, spark.read.parquet(f"{tmp_path}/3"), str(tmp_path))
        private = seen(now)
        assert private == sorted([(r[0], hidden(r[1]), len(hidden(r[1])), *r[3:]) for r in near], key=repr) and private != near
        now.write.parquet(f"{tmp_path}/4")

        library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
        ids = [np.array([*library.encode(r[1], add_special_tokens=False).ids, 0], "<u4") for r in private]
        pieces = stage["packing"](spark, spark.read.parquet(f"{tmp_path}/4"), str(tmp_path)).collect()
        fitting = {(r[0], p.start, p.length, p.ids_crc32) for p in pieces for r, x in zip(private, ids, strict=True) if p.doc_id == r[0] and zlib.crc32(x[p.start : p.start + p.length].tobytes()) == p.ids_crc32 and len(x) == p.doc_tokens}
        assert len(fitting) == len(pieces) and sum(p.length for p in pieces) == sum(map(len, ids))
        whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
        assert sorted((str(p.doc_id), p.start, p.length, p.ids_crc32) for p in whole) == sorted((str(p.doc_id), p.start, p.length, p.ids_crc32) for p in pieces) or sum(p.length for p in whole) == sum(map(len, ids))

        spark.createDataFrame([], df.schema).write.parquet(f"{tmp_path}/none/documents.parquet")
        assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
    finally:
        spark.conf.unset(pii.KEY_SETTING)
