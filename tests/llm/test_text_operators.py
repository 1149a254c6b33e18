"""The text operators on edge cases and against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from braidlog.llm import bpe, cdc, ngram_join, packing, pii, quality, shard, substrings, warc  # noqa: E402
from braidlog.llm import license as licences  # noqa: E402
from braidlog.llm.suffix import suffix_array  # noqa: E402
from plain import address, brute_components, card, day, luhn, social  # noqa: E402

WORDS = re.compile("[^\x20\x09-\x0d]+")
CLASH = "doc_id long, text string, id string, key string, payload string, row long, kind string, q_text string, shard int, part int, cell string, size long, component string"


def frame(spark, rows):
    """Documents with further columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "x", None, "y", 1, "c", "z", 3, None, "w", 9, "v") for i, t in rows], CLASH)


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(5)
    vocabulary = ["".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 6))) for _ in range(60)]

    def prose(n):
        return " ".join(rnd.choice(vocabulary) for _ in range(n))

    base = prose(120)
    out = [prose(rnd.randint(1, 90)) for _ in range(40)]
    out += [base] * 6 + [base + " " + prose(2) for _ in range(12)] + [base.upper(), base.replace(" ", "\n\t")]
    out += [prose(20) + " " + base[100:260] + " " + prose(20) for _ in range(5)]
    out += ["", None, None, " \n\t ", "one", "one two", "One  two", "\x00 \x1c\x85   x", "a" * 5000, "ab" * 3000, "ab" * 3001, prose(8000), "\U0001f600é" * 40, "it's   we'll\n\n\n x "]
    return list(enumerate(out))


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, [])


@pytest.fixture(scope="module")
def odd(spark):
    """Null and repeated ids, repeated rows."""
    return frame(spark, [(None, "same words here in this text of ten words or more"), (None, None), (1, "same words here in this text of ten words or more"), (1, "same words here in this text of ten words or more"), (1, "other"), (2, "")])


# --- 1: BPE ---------------------------------------------------------------------------------


def test_bpe_equals_the_library(docs, rows, empty, odd):
    import tiktoken

    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    encoded = bpe.encode(docs, ranks, public_tokenizers.PATTERN)
    got = {r.doc_id: r for r in bpe.decode(encoded, ranks).collect()}
    for i, text in rows:
        assert list(got[i].ids) == library.encode_ordinary(text or "")
        assert bytes(got[i].decoded) == (text or "").encode()
    assert bpe.encode(empty, ranks, public_tokenizers.PATTERN).count() == 0
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in bpe.encode(odd, ranks, public_tokenizers.PATTERN).collect()) == [(False, 1)] * 3 + [(False, 2)] + [(True, 0)] * 2


def test_decode_of_unknown_and_null_ids(spark):
    df = spark.createDataFrame([(1, [0, 1]), (2, None), (3, [])], "doc_id long, ids array<int>")
    got = {r.doc_id: r.decoded for r in bpe.decode(df, {b"a": 0, b"bc": 1}).collect()}
    assert (got[1], got[2], got[3]) == (b"abc", None, b"")
    with pytest.raises(Exception, match="token-byte table"):
        bpe.decode(spark.createDataFrame([(1, [7])], "doc_id long, ids array<int>"), {b"a": 0}).collect()


def test_latin_finder_equals_the_general_one():
    rnd = random.Random(3)
    alphabet = "abzÉß09 '\t\n.-_!’" + "st"
    general, quick = bpe.splitter(bpe.BYTE_LEVEL).findall, bpe.finder(bpe.BYTE_LEVEL)
    for _ in range(3000):
        text = "".join(rnd.choice(alphabet) for _ in range(14))
        assert general(text) == quick(text)


# --- 2: n-gram join -------------------------------------------------------------------------


@pytest.mark.parametrize(("n", "share", "bounds"), [(3, (90, 100), {}), (5, (80, 100), {}), (2, (50, 100), {"part_postings": 2, "cell_postings": 3, "part_grams": 60, "part_rows": 3})])
def test_components_equal_brute_force(docs, rows, n, share, bounds):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.components(docs, n, share, **bounds).collect()}
    assert got == brute_components(rows, n, *share)


@pytest.mark.parametrize(("n", "share", "tail"), [(3, (90, 100), 1), (3, (80, 100), 2), (2, (70, 100), 4)])
def test_template_rows_equal_brute_force(spark, n, share, tail):
    """Long posting lists of rows that nearly link: every part meets every other."""
    rnd = random.Random(4)
    body = "hello your order was shipped today thank you for shopping here"
    rows = [(i, f"{body} {' '.join(f'n{rnd.randrange(40)}' for _ in range(tail))}") for i in range(700)]
    df = frame(spark, rows).repartition(6)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.components(df, n, share, part_postings=50, cell_postings=40, part_grams=900).collect()}
    assert got == brute_components(rows, n, *share)


def test_components_edges(empty, odd):
    assert ngram_join.components(empty).count() == 0
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.components(odd, 5).collect()), key=repr)
    assert (None, 0, None) in got and (None, 7, None) in got
    assert got.count((1, 7, 1)) == 2 and (2, 0, 2) in got
    kept = ngram_join.keep_one(odd, 5)
    assert kept.columns == odd.columns and kept.count() == 6


def test_keep_one_on_repeated_rows(spark):
    rnd = random.Random(8)
    one, two, three = (" ".join(f"w{rnd.randrange(1000)}" for _ in range(60)) for _ in range(3))
    rows = [(5, one), (5, one), (5, two), (2, one + " end"), (None, two), (None, three), (None, three), (7, three + " end"), (None, ""), (9, None)]
    df = frame(spark, rows).repartition(3)
    got = sorted(((r.doc_id, r.text) for r in ngram_join.keep_one(df, 5, repeats=False).collect()), key=repr)
    assert got == sorted([(2, one + " end"), (5, two), (7, three + " end"), (None, ""), (9, None)], key=repr)
    texts = [(r.doc_id, r.text) for r in ngram_join.keep_one(df, 5).collect()]
    assert (5, two) in texts and (5, one) not in texts and texts.count((None, three)) == 2


# --- 3: licences ----------------------------------------------------------------------------


def test_licence_model_and_scan(spark, empty):
    model = licences.train()
    assert licences.held_out_accuracy(model) >= 0.9
    texts = ["prose\nReleased under the MIT License.\nmore", "Licensed under the Apache License, Version 2.0.", "You need a driving licence to rent a car.", None, "", "MIT", "Copyright 2021 Jane Doe. All rights reserved.\nLicensed under CC BY-NC 4.0."]
    got = [r.license_families for r in licences.scan(frame(spark, enumerate(texts)).coalesce(1), model).orderBy("doc_id").collect()]
    assert got == [["mit"], ["apache-2.0"], [], [], [], [], ["cc-by-nc", "proprietary"]]
    assert licences.scan(empty, model).count() == 0
    h = spark.range(1).select(F.pmod(F.xxhash64(F.lit("a licençe")), F.lit(licences.PLACES)).alias("h")).first().h
    assert h == licences.place("a licençe")


def scanned(text, model):
    """The scan of one text in plain Python, without the gate."""
    import numpy as np

    found, unknown = [], 0
    ends = re.compile(r"\n(?:(?:(?![^\W_]).)*\n)+|(?<=[.!?:])\n|(?<=[.!?:] )\n")
    for part in ends.split(text or ""):
        p = model.probabilities(part)
        family, fit = model.classes[int(np.argmax(p))], 0.0
        own = set(licences.word_pairs(licences.tokens(part)))
        for template in licences.TEMPLATES.get(family, ()):
            known = set(licences.word_pairs(licences.tokens(template)))
            both = len(own & known)
            fit = max(fit, both / len(known), both / len(own) if both >= 6 else 0.0)
        if family != licences.UNKNOWN and p.max() >= 0.5 and fit >= 0.5:
            found.append(family)
        elif re.search(f"(?i){licences.ANCHORS}", part):
            unknown += 1
    return sorted(set(found)), len(found), unknown


WRAPPED = {
    "gpl-3": "    This program is free software: you can redistribute it and/or modify\n    it under the terms of the GNU General Public License as published by\n    the Free Software Foundation, either version 3 of the License, or\n    (at your option) any later version.\n",
    "gpl-2": " * This program is free software; you can redistribute it and/or modify it\n * under the terms of the GNU General Public License as published by the Free\n * Software Foundation; either version 2 of the License, or (at your option)\n * any later version.\n *\n",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\n",
    "bsd": "# Redistribution and use in source and binary forms, with or without\n# modification, are permitted provided that the following conditions are\n# met:\n#\n",
    "apache-2.0": "// Licensed under the Apache License, Version 2.0 (the \"License\");\n// you may not use this file except in compliance with the License.\n",
}


def test_licences_equal_plain_python(spark, docs, rows):
    model = licences.train()
    texts = [f"Some words before.\n\n{x}\nSome words after." for x in WRAPPED.values()]
    texts += ["THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND,\nEXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES", "Released under GPLv3", "GPLv3 applies.", "the above copyright notice", "Released under the MIT\nLicense.\nAll rights reserved.", "it is free of charge for any person"]
    df = frame(spark, enumerate(texts)).repartition(2)
    got = {r.doc_id: (r.license_families, r.license_paragraphs, r.license_unknown) for r in licences.scan(df, model).collect()}
    assert got == {i: scanned(t, model) for i, t in enumerate(texts)}
    for i, family in enumerate(WRAPPED):
        assert got[i][0] == [family]
    assert got[5][0] == ["mit"] and got[6][0] == ["gpl-3"] and got[7] == ([], 0, 1)
    plain = {r.doc_id: (r.license_families, r.license_paragraphs, r.license_unknown) for r in licences.scan(docs, model).collect()}
    assert plain == {i: scanned(t, model) for i, t in rows}
    clash = spark.createDataFrame([(1, "All rights reserved.", 5, "x")], "doc_id long, text string, parts int, Found string")
    out = licences.scan(clash, model)
    assert out.columns[:4] == clash.columns and out.first()[:4] == clash.first()[:]


def test_sampled_lines_do_not_depend_on_the_partitions(spark, docs):
    assert licences.sample_lines(docs) == licences.sample_lines(docs.repartition(9)) != ()
    assert licences.sample_lines(docs.limit(0)) == ()


def test_held_out_rows_are_not_trained_on():
    lines = ("one two", "three four", "five six", "seven eight")
    a, b = (licences.train((*lines, held)) for held in ("zebra quilt", "yonder flax"))
    place = licences.place("zebra quilt")
    assert max(abs(a.bias - b.bias)) < 1e-9 and not a.weights[:, place].any()
    held = {i % 5 for i, (text, _) in enumerate(licences.labelled()) if text in licences.TEMPLATES["mit"]}
    assert held == {0}  # plain templates are always trained on


def test_licence_scan_uses_no_python(docs):
    plan = licences.scan(docs, licences.train())._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# --- 4: PII ---------------------------------------------------------------------------------


def test_pseudonyms_keep_formats(spark, empty):
    texts = [
        "Card 4785380592391139, again 4785-3805-9239-1139.", "4785380592391138 is no card", "Call +1 (743) 555-3824 or 743-555-3824!", "ip 227.5.221.1### and 999.1.1.1", "hein.19@mail5.example.com",
        "born 1999-02-28, not 1999-02-30", "ssn 123-45-6789 and 000-12-3456", 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"', None, "", "4465758382889437 4465758382889437", "x" * 20000 + " 227.5.221.1",
    ]
    df = frame(spark, enumerate(texts)).coalesce(1)
    out = {r.doc_id: r for r in pii.pseudonymise(df, "k", count_col="n", length_col="size").collect()}
    new = {i: r.text for i, r in out.items()}
    cards = re.findall(r"\d[\d-]{14,18}", new[0])
    assert len(cards) == 2 and all(luhn(c.replace("-", "")) for c in cards) and cards[0] == cards[1].replace("-", "") != "4785380592391139"
    assert new[1] == texts[1] and out[1].n == 0
    a, b = re.search(r"\+1 (\(\d{3}\) \d{3}-\d{4}) or (\d{3}-\d{3}-\d{4})!", new[2]).groups()
    assert re.sub(r"\D", "", a) == re.sub(r"\D", "", b) != "7435553824" and a[1] in "23456789"
    address = re.match(r"ip ([\d.]+)### and 999\.1\.1\.1", new[3]).group(1)
    assert all(int(x) < 256 for x in address.split(".")) and address != "227.5.221.1" and new[11].endswith(" " + address)
    assert re.fullmatch(r"[a-z]{4}\.\d\d@mail5\.example\.com", new[4]) and new[4] != texts[4]
    assert re.fullmatch(r"born \d{4}-\d\d-\d\d, not 1999-02-30", new[5]) and "1999-02-28" not in new[5]
    assert "123-45-6789" not in new[6] and new[6].endswith("000-12-3456")
    assert re.fullmatch(r'token = "[0-9a-f]{40}"', new[7]) and new[7] != texts[7]
    assert (new[8], new[9]) == (None, "") and out[0].size == len(new[0])
    assert len(set(new[10].split())) == 1 and out[10].n == 2
    assert pii.pseudonymise(empty, "k").count() == 0


def test_cards_beside_other_numbers(spark):
    plain, grouped = "4785380592391139", "4785 3805 9239 1139"
    texts = [
        plain, f"{plain} 123", f"{grouped} 12/27", f"order 12 {plain}", f"{grouped} 743-555-3824", f"{plain} 227.5.221.1", f"12 743-555-3824 {plain} {grouped}",
        f"{plain} 743.555.3824", f"{plain} 12@example.com", "1234 743-555-3824", "1 2 3", f"{plain} 24be64439e3e49cf46b2d7c90f3602a3d0b907ff", "7 " * 5 + plain,
    ]
    got = {r.doc_id: (r.text, r.n) for r in pii.pseudonymise(frame(spark, enumerate(texts)).coalesce(1), "k", count_col="n").collect()}
    new, wide = got[0][0], " ".join(got[0][0][i : i + 4] for i in range(0, 16, 4))
    assert luhn(new) and new != plain
    assert [got[i] for i in (1, 2, 3)] == [(f"{new} 123", 1), (f"{wide} 12/27", 1), (f"order 12 {new}", 1)]
    phone = got[4][0].removeprefix(wide + " ")
    assert got[4][1] == 2 and re.fullmatch(r"\d{3}-\d{3}-\d{4}", phone) and phone != "743-555-3824"
    assert got[5][1] == 2 and re.fullmatch(new + r" \d+\.\d+\.\d+\.\d+", got[5][0]) and "227.5.221.1" not in got[5][0]
    assert got[6] == (f"12 {phone} {new} {wide}", 3)
    assert got[7] == (f"{new} {phone.replace('-', '.')}", 2)
    assert got[8][1] == 2 and re.fullmatch(new + r" \d\d@example\.com", got[8][0])
    assert got[9] == (f"1234 {phone}", 1) and got[10] == ("1 2 3", 0)
    assert got[11][1] == 2 and got[11][0].startswith(new + " ") and not got[11][0].endswith("07ff")
    assert got[12][0].endswith(" " + new)


def test_permutations_are_one_to_one(spark):
    df = spark.range(7 * 11).select(pii.permute_pair(F.floor(F.col("id") / 11), F.col("id") % 11, 7, 11, "k", "t").alias("p"))
    assert df.distinct().count() == 77
    assert df.agg(F.max("p.x"), F.max("p.y"), F.min("p.x"), F.min("p.y")).first()[:] == (6, 10, 0, 0)
    days = lambda first, n: spark.range(n).select(F.date_format(F.date_add(F.lit(first).cast("date"), F.col("id").cast("int")), "yyyy-MM-dd").alias("d"))
    for first, n in (("0001-01-01", 36_595), ("1900-01-01", 73_000), ("9894-09-09", 38_464)):
        dates = days(first, n)
        moved = dates.select(pii._date(F.col("d"), "k").alias("d"))
        assert moved.distinct().count() == n and moved.exceptAll(dates).count() == 0
    assert days("9894-09-09", 38_464).agg(F.max("d")).first()[0] == "9999-12-31"
    odd = spark.createDataFrame([("0000-01-01",), ("2023-02-29",), ("9999-12-32",)], "d string")
    assert odd.select(pii.pseudonym(F.col("d"), "k").alias("d")).collect() == odd.collect()
    words = spark.createDataFrame([(a + b,) for a in "abcdefghij" for b in "0123456789"], "w string").select(pii.permute_text(F.col("w"), "k", "t").alias("w"))
    assert words.distinct().count() == 100 and words.where("w rlike '^[a-z][0-9]$'").count() == 100


def test_pseudonyms_equal_plain_python(spark):
    """Cards, addresses, social security numbers and dates by Feistel rounds in plain Python."""
    from datetime import date

    rnd, rows = random.Random(6), []
    for _ in range(60):
        body = "".join(rnd.choice("0123456789") for _ in range(rnd.randint(12, 18)))
        number = next(body + c for c in "0123456789" if luhn(body + c))
        ip = ".".join(str(rnd.randrange(256)) for _ in range(4))
        ssn = f"{rnd.choice([1, 665, 667, 899, rnd.randint(1, 665)]):03d}-{rnd.randint(1, 99):02d}-{rnd.randint(1, 9999):04d}"
        when = date.fromordinal(rnd.choice([1, 36594, 36595, 36596, 3613596, 3652059, rnd.randint(1, 3652059)])).isoformat()
        rows.append((f"a {number} b {ip}, c {ssn} d {when}", f"a {card(number)} b {address(ip)}, c {social(ssn)} d {day(when)}"))
    df = spark.createDataFrame([(a, b, 1, "y", 0) for a, b in rows], "text string, want string, found int, Made string, n long")
    out = pii.pseudonymise(df, "k", count_col="n").collect()
    assert [r.text for r in out] == [r.want for r in out] and {r.n for r in out} == {4} and {(r.found, r.Made) for r in out} == {(1, "y")}
    with pytest.raises(ValueError, match="key"):
        pii.pseudonymise(df, "")


def test_session_key(spark):
    assert pii.session_key(spark) == pii.session_key(spark) and len(pii.session_key(spark)) == 64
    spark.conf.set(pii.KEY_SETTING, "own")
    try:
        assert pii.session_key(spark) == "own"
    finally:
        spark.conf.unset(pii.KEY_SETTING)


def test_other_keys_give_other_pseudonyms(spark):
    df = frame(spark, [(1, "227.5.221.1")])
    assert pii.pseudonymise(df, "a").first().text != pii.pseudonymise(df, "b").first().text


# --- 5: shards ------------------------------------------------------------------------------


def test_shards(docs, rows, empty, odd):
    got = shard.shard(docs, 40).collect()
    text = dict(rows)
    slots = defaultdict(list)
    for r in got:
        data = (text[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(data) + 16, zlib.crc32(data), "key")
        assert r.grown_shard in (r.shard, 40) and 0 <= r.shard < 40
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert shard.shard(empty).count() == 0
    assert shard.shard(odd).count() == 6 and len({r.shard for r in shard.shard(odd).where("doc_id = 1").collect()}) == 1
    with pytest.raises(ValueError):
        shard.tree([])


@pytest.mark.parametrize("n", [1, 10, 40])
def test_places_equal_plain_python(spark, n):
    """Draws by the public hash, in plain Python; a shard added to racks that are not full takes rows only into itself."""
    import math
    import struct

    import xxhash

    weights = [1.0 + i % 3 for i in range(n)]

    def pick(key, level, parent, own):
        def draw(i):
            h = xxhash.xxh64_intdigest(level.encode(), 42)
            for data in (struct.pack("<i", parent), struct.pack("<i", i), struct.pack("<q", key)):
                h = xxhash.xxh64_intdigest(data, h)
            return math.log(((h & (1 << 53) - 1) + 1.0) / (1 << 53)) / own[i]

        return max(range(len(own)), key=lambda i: (draw(i), -i))

    def where(key, added):
        racks = [weights[i : i + 4] for i in range(0, n, 4)]
        regions = [racks[i : i + 2] for i in range(0, len(racks), 2)]
        region = pick(key, "region", 0, [sum(map(sum, r)) for r in regions] + added)
        if region == len(regions):
            return n
        rack = region * 2 + pick(key, "rack", region, [sum(r) for r in regions[region]])
        return rack * 4 + pick(key, "shard", rack, racks[rack])

    df = spark.range(-200, 200).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"), F.lit(1).alias("shard"))
    got = {r.doc_id: (r.shard, r.grown_shard) for r in shard.shard(df, n, weights=weights).collect()}
    assert got == {i: (where(i, []), where(i, [sum(weights) / n])) for i in range(-200, 200)}
    assert all(b in (a, n) for a, b in got.values()) and any(b == n for _, b in got.values())


def test_weights_and_movement(spark):
    ids = spark.range(20000)
    place = lambda w: {r.id: r.s for r in ids.select("id", shard.place(F.col("id"), w).alias("s")).collect()}
    even, heavy = place([1.0] * 16), place([1.0] * 5 + [3.0] + [1.0] * 10)
    n = Counter(even.values())
    assert min(n.values()) > 1000 and max(n.values()) < 1500
    assert 2800 < Counter(heavy.values())[5] < 3900
    moved = {i for i in even if even[i] != heavy[i]}
    assert all(heavy[i] // 8 == 0 for i in moved)  # only into the region whose weight grew


# --- 6: quality -----------------------------------------------------------------------------


def test_quality_counts_equal_brute_force(docs, rows, empty, odd):
    got = {r.doc_id: r for r in quality.clean(docs).collect()}
    for i, text in rows:
        text = text or ""
        words = WORDS.findall(text)
        windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
        often = Counter(windows)
        covered = {k + j for k, w in enumerate(windows) if often[w] > 1 for j in range(5)}
        lines = [x for x in text.split("\n") if WORDS.search(x)]
        r = got[i]
        assert (r.q_n_words, r.q_chars, r.q_symbols, r.q_dup_lines, r.q_repeat_words) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))
        assert r.q_base_failed == (len(words) < 10 or 100 * len(covered) > 20 * len(words))
    assert quality.clean(empty).count() == 0 and quality.clean(odd).count() == 6


def test_quality_rules(spark):
    good = "This is a plain sentence with more than ten words in it, and it ends."
    texts = [good, good + "\nhome | about | news | contact | more", "BUY!! NOW!! CHEAP!! " * 5, "a### b*** c$$$ d%%% e&&& " * 4, good + "\n" + good, "We use cookies. Click here.\n" + good]
    kept = {r.doc_id: (r.text, r.size) for r in quality.keep_clean(frame(spark, enumerate(texts)), length_col="size").collect()}
    assert {i: t for i, (t, _) in kept.items()} == {0: good, 1: good, 5: good}
    assert all(n == len(good) for _, n in kept.values())


def test_quality_keeps_other_columns(spark):
    good = "This is a plain sentence with more than ten words in it, and it ends."
    df = spark.createDataFrame([(1, good, "a", "b", 3, "c")], "doc_id long, text string, q_source string, q_text string, Q_KEPT int, `x.y` string")
    assert quality.keep_clean(df).collect() == df.collect() and quality.keep_clean(df).columns == df.columns
    judged = quality.clean(df)
    assert judged.columns == ["doc_id", "text", "q_source", "x.y", *quality.RESULTS] and judged.first().q_source == "a"


# --- 7: packing -----------------------------------------------------------------------------


def test_packing(docs, rows, empty, odd):
    from tokenizers import Tokenizer

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as source:
        text = source.read()
    library = Tokenizer.from_str(text)
    library.encode_special_tokens = True
    import numpy as np

    ids = {i: np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for i, t in rows}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in packing.pack(docs, text).collect():
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
        assert r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
    for parts, total in [(pieces[i], len(ids[i])) for i in ids] + [(s, None) for s in sequences.values()]:
        at = 0
        for start, length in sorted(parts):
            assert start == at and length > 0
            at += length
        assert at == total if total is not None else at <= 1024
    assert sum(sum(n for _, n in s) < 1024 for s in sequences.values()) <= 1
    assert packing.pack(empty, text).count() == 0
    assert packing.pack(odd, text).count() >= 6
    with pytest.raises(ValueError):
        packing.read_tokenizer(text.replace('"type":"ByteLevel"', '"type":"Other"').replace('"type": "ByteLevel"', '"type": "Other"'))


def test_packing_of_added_tokens(spark):
    import numpy as np
    from tokenizers import Tokenizer

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as source:
        text = source.read()
    library = Tokenizer.from_str(text)
    end = "<|endoftext|>"
    texts = [f"abc {end} def", end, f"x{end}{end} y  {end}\n z", f"it's{end}'s é  {end}  ", "<|endoftext| >", f"<{end}>", "plain", None, f"word {end} " * 600]
    ids = [np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for t in texts]
    assert 50256 in ids[0]
    seen = Counter()
    for r in packing.pack(frame(spark, enumerate(texts)), text).collect():
        assert r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
        seen[r.doc_id] += r.length
    assert seen == Counter({i: len(x) for i, x in enumerate(ids)})
    import json

    other = json.loads(text)
    other["added_tokens"][0]["lstrip"] = True
    with pytest.raises(ValueError, match="lstrip"):
        packing.added_tokens(json.dumps(other))


def test_plan_uses_up_a_histogram_that_fits():
    import numpy as np

    counts = np.zeros(16, np.int64)
    counts[[3, 13, 4, 6, 8]] = [5, 5, 7, 14, 10]  # 3 + 13, 4 + 6 + 6, 8 + 8
    chosen = packing.plan(counts, 16)
    _, used = packing.slots(chosen, 16)
    assert all(sum(lengths) == 16 for lengths, _ in chosen)
    assert used.tolist() == counts.tolist()


def test_solution_is_optimal_and_residuals_fit_best():
    import numpy as np

    rnd = np.random.default_rng(3)
    for window in (24, 60):
        counts = rnd.integers(0, 400, window)
        combos = packing.combinations(window, counts)
        x = packing.solve(counts, combos)
        rest = counts.astype(float)
        rest[0] = 0
        for k, row in enumerate(combos.tolist()):
            for v in row:
                if v:
                    rest[v] -= x[k]
        pull = np.array([sum(rest[v] for v in row if v) for row in combos.tolist()])
        least = max(0.5, packing.TOLERANCE * counts[1:].max())
        assert (x >= 0).all() and (pull <= least + 1e-6).all() and (pull[x > 0] >= -least - 1e-6).all()
        chosen = packing.plan(counts, window)
        _, used = packing.slots(chosen, window)
        assert all(sum(lengths) == window and times > 0 for lengths, times in chosen) and (used[1:] <= counts[1:]).all()
    left = np.zeros(16, np.int64)
    left[[9, 7, 5, 2, 1]] = [3, 1, 2, 3, 1]
    assert packing.best_fits(left, 16) == [((9, 7), 1), ((9, 5, 2), 2)]
    assert left.tolist() == [0, 1, 1] + [0] * 13


# --- 8: repeated strings --------------------------------------------------------------------


def test_suffix_array():
    rnd = random.Random(1)
    for n in [*range(12), 100, 700]:
        for letters in (1, 2, 4, 26):
            text = bytes(rnd.randrange(letters) + 97 for _ in range(n))
            assert suffix_array(text) == sorted(range(n), key=lambda i, t=text: t[i:])


@pytest.mark.parametrize("many_blocks", [substrings.MANY_BLOCKS, 1])
def test_repeats_equal_brute_force(docs, rows, empty, odd, many_blocks):
    got = {r.doc_id: r for r in substrings.remove_repeats(docs, many_blocks=many_blocks).collect()}
    seen = set()
    for i, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        windows = [data[k : k + 50] for k in range(len(data) - 49)]
        for k, w in enumerate(windows):
            if w in seen:
                gone[k : k + 50] = b"\1" * 50
        seen.update(windows)
        kept = bytes(c for c, g in zip(data, gone, strict=True) if not g)
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) == (len(data), sum(gone), len(re.findall(b"\1+", bytes(gone))), kept)
    assert substrings.remove_repeats(empty).count() == 0
    some = substrings.remove_repeats(odd, 20).collect()
    assert sorted((r.doc_id is None, r.n_removed) for r in some) == [(False, 0)] * 4 + [(True, 0), (True, 49)]


def test_repeats_of_one_anchor_by_windows(docs, spark):
    """Many different segments around one string: dealt out by window, they remove the same bytes."""
    key = lambda df: sorted(((r.doc_id, r.n_removed, r.n_spans, bytes(r.kept)) for r in df.collect()), key=repr)
    assert key(substrings.remove_repeats(docs, many_segments=0)) == key(substrings.remove_repeats(docs))
    rows = [(i, f"{i % 40:030d}" + "a phrase that every row has in its midst" + f"{i % 7:030d}") for i in range(400)]
    around = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert key(substrings.remove_repeats(around, many_segments=10)) == key(substrings.remove_repeats(around))


def test_different_segments_have_different_marks():
    data = np.frombuffer(b"".join(b"%040d the same phrase for all of them %040d" % (i, i) for i in (1, 2, 1)), np.uint8)
    first, end, anchor, _, mark = substrings.segments(data, 50, 20)
    strings = [(data[a : b + 49].tobytes(), p - a) for a, b, p in zip(first.tolist(), end.tolist(), anchor.tolist(), strict=True)]
    assert len(set(mark.tolist())) == len(set(strings)) < len(strings)


# --- 9: WARC --------------------------------------------------------------------------------


def test_warc_round_trip(spark, tmp_path):
    page = "<html>" + "é" * 80
    rows = [(1, "http://a/", page), (2, None, page), (3, "http://b/\r\nX: y", "short"), (4, "u", "short"), (5, "u", None), (6, "u", "\r\n\r\nWARC/1.1\r\n\r\n" * 20), (None, "u", page), (7, "u", "")]
    pages = spark.createDataFrame([(*r, "k", 1) for r in rows], "page_id long, url string, html string, digest string, size int").repartition(3)
    folder = "file://" + str(tmp_path / "warc")
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(pages, folder).collect()), key=repr)
    want = []
    for i, _, html in rows:
        data = (html or "").encode()
        again = html == page and i != 1
        want.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", 1 if again else None))
    assert got == sorted(want, key=repr)
    members = sorted((tmp_path / "warc").glob("members-*.gz"))
    assert members and not list((tmp_path / "warc").glob("*.tmp"))
    lines = [x.split("\t") for m in members for x in (m.parent / (m.name + ".idx")).read_text().splitlines()]
    assert len(lines) == len(rows)
    first = members[0]
    for line in (first.parent / (first.name + ".idx")).read_text().splitlines():
        _, at, size = line.split("\t")
        assert zlib.decompress(first.read_bytes()[int(at) : int(at) + int(size)], 31).startswith(b"WARC/1.1")
    assert warc.round_trip(pages.limit(0)).count() == 0
    twice = sorted((r.page_id, r.record_type) for r in warc.round_trip(pages.where("page_id = 1").union(pages.where("page_id in (1, 2)"))).collect())
    assert twice == [(1, "response"), (1, "response"), (2, "revisit")]


# --- 10: chunk recipes ----------------------------------------------------------------------


def test_recipes_equal_brute_force(docs, rows, empty, odd):
    groups = defaultdict(list)
    for i, text in rows:
        groups[re.sub("[\x20\x09-\x0d]", "", text or "")].append((-len(text or ""), i))
    got = {r.doc_id: r for r in cdc.dedup(docs).collect()}
    for bare, members in groups.items():
        first = min(members)[1]
        for _, i in members:
            r = got[i]
            assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (first, len(members), i == first, hashlib.sha256(bare.encode()).hexdigest())
    assert cdc.dedup(empty).count() == 0
    some = cdc.dedup(odd).collect()
    assert sum(r.kept for r in some) == 3 and sorted(r.group_size for r in some) == [1, 2, 2, 3, 3, 3]
    kept = cdc.keep_first(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)


def test_keep_first_on_repeated_rows(spark, odd):
    rows = [(1, "a b"), (1, "a b"), (1, "other"), (4, "other"), (0, "other"), (1, "third"), (None, "null"), (None, "null"), (3, "null"), (None, "only"), (None, "only"), (8, None), (8, "")]
    df = frame(spark, rows).repartition(3)
    kept = cdc.keep_first(df)
    got = sorted(((r.doc_id, r.text or "") for r in kept.collect()), key=repr)
    assert kept.columns == df.columns
    assert got == sorted([(1, "a b"), (0, "other"), (1, "third"), (3, "null"), (None, "only"), (8, "")], key=repr)
    assert cdc.keep_first(odd).count() == 3


def test_chunks_do_not_depend_on_what_comes_before():
    rnd = random.Random(2)
    data = bytes(rnd.randrange(97, 120) for _ in range(200_000))
    own = cdc.chunks(data)
    assert b"".join(own) == data and max(map(len, own)) <= cdc.MOST
    shifted = cdc.chunks(b"something new" + data)
    assert len(set(own) & set(shifted)) > 0.9 * len(own)
    assert list(cdc.candidates(data, 1000)) == list(cdc.candidates(data))
    assert cdc.chunks(b"") == []


def test_buckets_are_dealt_evenly(spark, monkeypatch):
    """No task holds two buckets, and blocks lie evenly, however many there are."""
    from pyspark.sql import functions as F

    from braidlog.llm import blocks as B

    sent = []
    exchange = B.exchange
    monkeypatch.setattr(B, "exchange", lambda df: sent.append(exchange(df)) or sent[-1])
    docs = spark.createDataFrame([(i, f"text {i} and " + "one passage that all of the documents share, word by word " * 3) for i in range(300)], "doc_id long, text string")
    assert substrings.remove_repeats(docs).where("n_removed > 0").count() == 299
    held = sent[0].where("key like 'w%'").groupBy(F.spark_partition_id().alias("p")).agg(F.count_distinct("key").alias("n")).collect()
    assert held and {r.n for r in held} == {1}
    for n in (1, 5, 64, 600):
        keys = spark.createDataFrame([(k,) for k in B.bucket_keys(n)], "key string").select(F.expr(f"pmod(hash(key), {n})").alias("p"))
        assert [r.p for r in keys.collect()] == list(range(n))
    for each in (1, 4):
        names = spark.createDataFrame([("b" + B.even_block(f"{part}-{seq}", 64),) for part in range(64 // each * 2) for seq in range(each)], "key string")
        most = names.groupBy(F.expr("pmod(hash(key), 64)")).count().agg(F.max("count")).first()[0]
        assert most <= 4


def test_segments_decided_in_parts(docs, rows, empty, odd, monkeypatch):
    """Parts of a bucket give what the whole bucket gives."""
    monkeypatch.setattr(substrings, "TOGETHER", 2)
    test_repeats_equal_brute_force(docs, rows, empty, odd, substrings.MANY_BLOCKS)
