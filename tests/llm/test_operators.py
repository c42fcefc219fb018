import random
import re
import zlib

import numpy as np
import pytest

from lattica.llm import decontamination, jaccard_join, licenses, packing, pii, quality_classifier, quality_rules, registry, substring_dedup, token_counts, toxicity
from lattica.llm.common import read
from lattica.llm.tokens import Encoder, encoding
from oracle import rows_of, rows_of_sql, tables


def key(row):
    return tuple((x is None, x if x is not None else 0) for x in row)


def ordered(rows):
    return sorted(map(tuple, rows), key=key)


def texts(df):
    return [(r.doc_id, r.text) for r in df.collect()]


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, sf, name):
    assert rows_of(registry.QUERIES[name](spark, sf)) == rows_of_sql(tables(sf), registry.SQL[name])


def test_awkward_rows(spark, awkward, empty, some_labels):
    n = awkward.count()
    items = spark.createDataFrame([(0, "a b c d e f g"), (1, None), (2, ""), (3, "x")], "item_id long, text string")
    assert ordered(substring_dedup.substring_dedup(awkward).collect()) == ordered(substring_dedup.brute_force(texts(awkward)))
    assert ordered(jaccard_join.jaccard_classes(awkward).collect()) == ordered(jaccard_join.brute_force(texts(awkward)))
    assert ordered(decontamination.contained(awkward, items).collect()) == ordered(decontamination.brute_force(texts(awkward), texts(items.withColumnRenamed("item_id", "doc_id"))))
    assert ordered((r.doc_id, r.text, r.n_pseudonyms) for r in pii.pii(awkward, pii.DEMONSTRATION).collect()) == ordered((d, *pii.brute_force(t)) for d, t in texts(awkward))
    for df in (licenses.licenses(awkward), quality_rules.quality_rules(awkward), toxicity.toxicity(awkward, some_labels), quality_classifier.classify(awkward, some_labels), token_counts.token_counts(awkward)):
        assert len(df.collect()) == n
    assert sum(r.length for r in packing.pack(awkward).collect()) == sum(len(encoding().encode_ordinary(t or "")) + 1 for _, t in texts(awkward))
    for df in (
        substring_dedup.substring_dedup(empty), jaccard_join.jaccard_classes(empty), decontamination.contained(empty, items), pii.pii(empty, 'k'), licenses.licenses(empty),
        quality_rules.quality_rules(empty), toxicity.toxicity(empty, some_labels), quality_classifier.classify(empty, some_labels), token_counts.token_counts(empty), packing.pack(empty),
    ):
        assert df.collect() == []
    for df in (quality_rules.keep_good(awkward), jaccard_join.keep_one(awkward), decontamination.keep_clean(awkward, items), pii.pseudonymize(awkward, 'k')):
        assert df.columns == awkward.columns and df.count() <= n


def test_substring_dedup_brute_force(spark):
    random.seed(5)
    base = ["".join(random.choice("abc") for _ in range(3)) for _ in range(400)]
    docs = []
    for _ in range(120):
        w = []
        for _ in range(random.randrange(4)):
            a = random.randrange(300)
            w += base[a : a + random.randrange(90)] + [str(random.randrange(9))] * random.randrange(3)
        docs.append((random.randrange(100) if random.random() < 0.9 else None, random.choice([" ", "\n", " \t"]).join(w)))
    docs += docs[:20] + [(7, "x " * 130), (9, "x " * 130)]
    found = ordered(substring_dedup.substring_dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect())
    assert found == ordered(substring_dedup.brute_force(docs))
    assert sum(r[2] > 0 for r in found) > 20


def test_jaccard_join_brute_force(spark):
    random.seed(3)
    docs = []
    passage = [f"p{i}" for i in range(25)]
    for _ in range(60):
        base = [random.choice("abcdefghij") + str(random.randrange(50)) for _ in range(random.choice([1, 2, 4, 6, 8, 12, 20, 30, 60]))]
        if random.random() < 0.3:
            base += passage
        for _ in range(6):
            w = list(base)
            for _ in range(random.randrange(4)):
                k, i = random.randrange(3), random.randrange(len(w)) if w else 0
                if k == 0 and w:
                    w[i] = f"x{random.randrange(9)}"
                elif k == 1 and w:
                    del w[i]
                else:
                    w.insert(i, f"y{random.randrange(9)}")
            docs.append((len(docs) if random.random() < 0.95 else None, " ".join(w)))
    # Some ids twice, for other texts.
    docs += [(d, docs[(i * 7 + 50) % 300][1]) for i, (d, _) in enumerate(docs[:40])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = ordered(jaccard_join.brute_force(docs))
    assert ordered(jaccard_join.jaccard_classes(df).collect()) == want
    # Either side of the switch by key size, and ids of so few bits that many sets share one.
    assert ordered(jaccard_join.jaccard_classes(df, small=2).collect()) == want
    assert ordered(jaccard_join.jaccard_classes(df, small=10**6, id_bits=7).collect()) == want


def test_jaccard_blocks(spark, monkeypatch):
    """Keys with many components, in cells of few documents: each pair of different components once."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 3)
    monkeypatch.setattr(jaccard_join, "PROBES", 4)
    random.seed(21)
    sketch = jaccard_join.sketch_of(np.arange(10, dtype=np.uint64))
    component = [random.randrange(1, 6) for _ in range(40)]
    n = [random.choice([10, 11, 20]) for _ in component]
    rows = [(k, i, component[i], n[i]) for k in (7, 8) for i in range(40) if random.random() < 0.8]
    nodes = spark.createDataFrame([(i, sketch, None) for i in range(40)], "node long, sketch binary, brief binary")
    found = jaccard_join.unconnected(spark.createDataFrame(rows, "key long, node long, component long, n long"), nodes).distinct().collect()
    on = {k: {r[1] for r in rows if r[0] == k} for k in (7, 8)}
    want = {(i, j) for s in on.values() for i in s for j in s if i < j and component[i] != component[j] and 4 * min(n[i], n[j]) >= 3 * max(n[i], n[j])}
    assert sorted(map(tuple, found)) == sorted(want)


def test_keep_one_by_row(spark):
    """Repeated and null ids: a row goes or stays by its own text, and one row of each component stays."""
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(12)) for x in "abcd")
    rows = [(1, a), (5, a), (5, b), (None, a), (None, c), (None, c), (7, d), (7, d), (8, "A" + a[1:]), (9, None), (9, ""), (None, None), (4, "x"), (3, "x")]
    df = spark.createDataFrame([(i, t, f"row {n}") for n, (i, t) in enumerate(rows)], "doc_id long, text string, node string")
    for bits in (64, 2):
        kept = [(r.doc_id, r.text) for r in jaccard_join.keep_one(df, bits).collect()]
        assert ordered(kept) == ordered([(1, a), (5, b), (None, c), (7, d), (9, None), (9, ""), (None, None), (3, "x")])
        assert jaccard_join.keep_one(df, bits).columns == df.columns


def test_sketch_bounds_difference():
    random.seed(1)
    for _ in range(200):
        pool = np.unique(np.random.default_rng(random.randrange(10**6)).integers(0, 2**64, 3000, dtype=np.uint64))
        n, m = random.randrange(5, 1400), random.randrange(5, 1400)
        a, b = pool[:n], pool[random.randrange(n) :][:m]
        apart = len(np.setxor1d(a, b))
        assert jaccard_join.sketches_differ(jaccard_join.sketch_of(a), jaccard_join.sketch_of(b)) <= apart
        both = len(np.intersect1d(a, b))
        if 100 * both >= 75 * (len(a) + len(b) - both) and apart:
            (ka, sa), (kb, sb) = jaccard_join.keys_of(a), jaccard_join.keys_of(b)
            assert len(np.intersect1d(ka, kb)) >= max(sa, sb)


def test_longest_repeats():
    random.seed(2)
    for _ in range(200):
        t = [random.randrange(random.choice([1, 2, 3, 9])) for _ in range(random.randrange(30))]
        want = [0] * len(t)
        for i in range(len(t)):
            for j in range(len(t)):
                k = 0
                while i != j and max(i, j) + k < len(t) and t[i + k] == t[j + k]:
                    k += 1
                want[i] = max(want[i], k)
        assert quality_rules.longest_repeats(np.array(t, dtype=np.uint64)).tolist() == want


def test_encoder_equals_tokenizers():
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encoder = Encoder()
    random.seed(4)
    pieces = [" ", "\n", "a", "b1", "'s", ".", "\t", "Ñ", "<|endoftext|>", "  ", " ", "日本", "Wort"]
    for _ in range(3000):
        t = "".join(random.choice(pieces) for _ in range(random.randrange(14)))
        assert encoder.one(t) == np.array(tokenizer.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes(), repr(t)


def test_packing_round_trip(spark, sf):
    docs = read(spark, sf, "documents")
    ids = {r.doc_id: np.array([*encoding().encode_ordinary(r.text), 1], dtype="<u4") for r in docs.collect()}
    pieces, room = packing.pack(docs).collect(), {}
    seen = {d: np.zeros(len(v), dtype=int) for d, v in ids.items()}
    for p in pieces:
        assert p.doc_tokens == len(ids[p.doc_id])
        assert p.ids_crc32 == zlib.crc32(ids[p.doc_id][p.start : p.start + p.length].tobytes())
        seen[p.doc_id][p.start : p.start + p.length] += 1
        room.setdefault(p.sequence_id, []).append((p.offset, p.length))
    assert all((v == 1).all() for v in seen.values())
    for spans in room.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= packing.LENGTH
    assert sum(map(len, ids.values())) / (packing.LENGTH * len(room)) > 0.97


def test_first_fit_decreasing():
    random.seed(6)
    for _ in range(50):
        sizes = [random.randrange(1, 101) for _ in range(random.randrange(60))]
        bins, offsets = packing.first_fit_decreasing(np.array(sizes, dtype=np.int64), 100)
        free: list[int] = []
        for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
            at = next((b for b, r in enumerate(free) if r >= sizes[i]), len(free))
            if at == len(free):
                free.append(100)
            assert (bins[i], offsets[i]) == (at, 100 - free[at])
            free[at] -= sizes[i]


def test_pii_brute_force(spark, sf):
    docs = read(spark, sf, "documents")
    want = {d: pii.brute_force(t) for d, t in texts(docs)}
    found = {r.doc_id: (r.text, r.n_pseudonyms) for r in pii.pii(docs, pii.DEMONSTRATION).collect()}
    assert found == want and sum(n for _, n in found.values()) > 5


def test_pii_stays_valid_and_apart(spark):
    """Numbers and dates of every format: pseudonyms pass the same validation and are as many as the values."""
    random.seed(9)
    ssn = {f"{random.randrange(1, 900):03d}-{random.randrange(1, 100):02d}-{random.randrange(1, 10000):04d}" for _ in range(400)} | {"665-01-0001", "667-99-9999", "001-01-0001", "899-99-9999"}
    ssn = sorted(x for x in ssn if not x.startswith("666"))
    first = [f"{m:02d}/{d:02d}/{y}" for y in (1999, 2024) for m in (1, 2, 12) for d in (3, 12, 13, 28)]
    values = [*ssn, *first, "2024-02-29", "0001-01-01", "29.02.2024", "31/12/1999", "12.34.56.78", "(555) 123-4567", "555-123-4567", "4556 7375 8689 9855"]
    docs = spark.createDataFrame(list(enumerate(values)), "doc_id long, text string")
    found = {r.doc_id: (r.text, r.n_pseudonyms) for r in pii.pii(docs, "another key").collect()}
    assert found == {i: pii.brute_force(v, "another key") for i, v in enumerate(values)}
    new = [found[i][0] for i in range(len(values))]
    assert all(n == 1 for _, n in found.values()) and len(set(new)) == len(values)
    assert all(pii.brute_force(v)[1] == 1 and re.sub("[0-9]+", "9", v) == re.sub("[0-9]+", "9", w) for v, w in zip(new, values))
    for v, w in zip(new[len(ssn) :][: len(first)], first):
        assert (int(v[3:5]) > 12) == (int(w[3:5]) > 12) or int(w[:2]) <= 12 and int(w[3:5]) <= 12


def test_pii_keeps_other_columns_and_its_key_private(spark, awkward):
    docs = awkward.selectExpr("*", "array(1) AS `a.b`").where("doc_id IS NOT NULL").unionByName(awkward.limit(1).selectExpr("* EXCEPT (text)", "'mail a.b1@x.org' AS text", "array(1) AS `a.b`"))
    out = pii.pseudonymize(docs, "not to be seen")
    assert out.columns == docs.columns
    plan = out._jdf.queryExecution().toString()
    assert "not to be seen" not in plan and "Python" not in plan.replace("applySchemaToPythonRDD", "")
    others = [c for c in docs.columns if c != "text"]
    pick = lambda df: sorted(repr([r[c] for c in others]) for r in df.collect())
    assert pick(out) == pick(docs)
    assert not any("a.b1@" in str(v) for r in out.collect() for v in r)
    with pytest.raises(TypeError):
        pii.pseudonymize(docs)


def test_pii_formats():
    card, n = pii.brute_force("4556737586899855")
    digits = [int(c) for c in card]
    assert n == 1 and len(card) == 16 and card != "4556737586899855"
    assert sum(x if i % 2 else (2 * x - 9 * (x > 4)) for i, x in enumerate(digits)) % 10 == 0
    days = {pii.brute_force(f"2024-01-{d:02d}")[0] for d in range(1, 32)}
    assert len(days) == 31
    assert pii.brute_force("4556737586899856 256.1.1.1 2023-02-29") == ("4556737586899856 256.1.1.1 2023-02-29", 0)


def _tokens(text):
    return len(Encoder().one(text)) // 4


def _balanced(tree):
    return all(tree.nodes[i] == tuple(map(sum, zip(tree.nodes[2 * i], tree.nodes[2 * i + 1]))) for i in range(1, tree.leaves)) and [b.sums() for b in tree.blocks] == tree.nodes[tree.leaves : tree.leaves + len(tree.blocks)]


@pytest.mark.parametrize("block", [2, 64])
def test_token_edits(monkeypatch, block):
    monkeypatch.setattr(token_counts, "BLOCK", block)
    splitter, enc = token_counts.Splitter(), Encoder()
    random.seed(2)
    pieces = [" ", "\n", "a", "b1", "'s", "'re", ".", "\t", "Ñ", "  ", "12", "x@y.de", "<|endoftext|>", "<|endof", "text|>", " " * 30, "a" * 30]
    for _ in range(400):
        text = "".join(random.choice(pieces) for _ in range(random.randrange(40)))
        doc = token_counts.Document(text, splitter)
        for _ in range(6):
            a = random.randrange(len(text) + 1)
            b = random.randrange(a, min(len(text), a + random.choice([0, 6, 60])) + 1)
            new = "".join(random.choice(pieces) for _ in range(random.randrange(4)))
            text = text[:a] + new + text[b:]
            doc.edit(a, b, new)
            assert doc.text == text and doc.tree.total == len(enc.one(text)) // 4
            assert doc.pretokens == len(splitter.pretokens(text)) and _balanced(doc.tree)


def test_token_edits_touch_little():
    """Many edits of one text: each encodes a few pre-tokens, and the work does not grow with the square."""
    import time

    splitter = token_counts.Splitter()
    text = "some words, 12 of them.  And more\n" * 40_000
    edits = [(m.start(), m.end(), " long er") for m in re.finditer("  ", text)]
    began = time.time()
    doc, before, done, skipped = token_counts.apply_edits(text, edits, splitter)
    assert (done, skipped, before) == (40_000, 0, _tokens(text)) and doc.tree.total == _tokens(text.replace("  ", " long er"))
    assert doc.reencoded < 40_000 * 14 and time.time() - began < 20


def test_token_counts_by_rule_brute_force(spark, awkward):
    """The default edit log applied as plain replacements, from the right."""
    rows = texts(awkward) + [(20, "mail a.b1@x.org\t\tnow  1234567890123 <|endoftext|>  <|endoftext|>\n\n\nend")]
    found = token_counts.token_counts(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = []
    for d, t in rows:
        after, edits = t or "", token_counts.rule_edits(t or "")
        for a, b, new in reversed(edits):
            after = after[:a] + new + after[b:]
        want.append((d, _tokens(t or ""), len(edits), 0, _tokens(after)))
    assert ordered(r[:5] for r in found) == ordered(want)
    assert (20, _tokens(rows[-1][1]), 6, 0, _tokens("mail <email> now <number> <|endoftext|> <|endoftext|>\nend")) in want


def test_token_edit_log(spark):
    docs = spark.createDataFrame([(1, "hello  world"), (2, "plain")], "doc_id long, text string")
    log = spark.createDataFrame([(1, 5, 7, " "), (1, 6, 9, "overlaps"), (1, 99, 100, "beyond"), (2, 0, 0, "very ")], "doc_id long, start long, end long, replacement string")
    found = {r.doc_id: r for r in token_counts.token_counts(docs, log).collect()}
    assert (found[1].n_edits, found[1].n_skipped) == (1, 2)
    assert found[1].n_tokens_after == len(encoding().encode_ordinary("hello world"))
    assert found[2].n_tokens_after == len(encoding().encode_ordinary("very plain"))


def _held_out(df, labels, column):
    truth = {r.doc_id: r[column] for r in labels.collect()}
    rows = [(r.score, r.predicted, truth[r.doc_id]) for r in df.collect() if r.held_out and r.doc_id in truth]
    return rows, sum(p == y for _, p, y in rows) / len(rows)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels = read(spark, sf, "labels")
    assert _held_out(quality_classifier.classify(read(spark, sf, "documents"), labels), labels, "quality")[1] > 0.95
    assert _held_out(toxicity.toxicity(read(spark, sf, "documents"), labels), labels, "toxic")[1] > 0.9


def test_license_sequences(spark):
    text = "Intro. Permission is hereby granted, free of charge, to any person obtaining a copy of this software.\nOther words here.\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\nTHE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND. All rights reserved."
    docs = spark.createDataFrame([(1, text), (2, "Licensed under the Apache License, Version 2.0."), (3, "the software is provided as is without warranty of any kind")], "doc_id long, text string")
    found = {r.doc_id: (r.n_sentences, r.licenses) for r in licenses.licenses(docs).collect()}
    assert found == {1: (4, "MIT,all-rights-reserved"), 2: (1, "Apache-2.0"), 3: (1, "")}


def test_queries_cover_operators():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 14))


def test_decontamination_blocks(spark, sf):
    docs, items = read(spark, sf, "documents"), read(spark, sf, "benchmark")
    assert ordered(decontamination.contained(docs, items, block_chars=2000).collect()) == ordered(decontamination.contained(docs, items).collect())


def _training(words_of, n=300):
    """Documents and labels with a frequent word for each label to calibrate on; words_of(i, toxic) adds to those that models are fitted on."""
    docs, labels = [], []
    for i in range(n):
        toxic, fold = i % 2, zlib.crc32(str(i).encode()) % 5
        docs.append((i, " ".join([["harmlos", "schlimm"][toxic]] * 3 + (words_of(i, toxic) if fold in (1, 2, 3) else []))))
        labels.append((i, toxic))
    return docs, labels


def _scores(spark, docs, labels, probes):
    rows = docs + [(10_000 + i, t) for i, t in enumerate(probes)]
    df = toxicity.toxicity(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    found = {r.doc_id: r.score for r in df.collect()}
    return [found[10_000 + i] for i in range(len(probes))]


def test_toxicity_counts_every_rare_start(spark):
    """Over 250,000 starts that occur once: those late in the alphabet count as well."""
    random.seed(7)
    rare = {0: [], 1: []}

    def words_of(i, toxic):
        rare[toxic].append(f"zz{chr(97 + len(rare[toxic]) // 26)}{chr(97 + len(rare[toxic]) % 26)}" + ["mul", "kor"][toxic])
        return [rare[toxic][-1]] + ["".join(random.choice("abcdefghijklm") for _ in range(12)) for _ in range(300)]

    docs, labels = _training(words_of)
    n = min(map(len, rare.values()))
    scores = _scores(spark, docs, labels, rare[0][:n] + rare[1][:n])
    assert n > 50 and all(a < b for a, b in zip(scores[:n], scores[n:]))


def test_rule_edits_addresses():
    splitter, enc = token_counts.Splitter(), encoding()
    found = 0
    for address in ("und.34@mail7.example.com", "john.smith@x.org", "a_b@x.org", "_a%b+c-d9@my-host.co.uk", "7@x.de", "żółć.1@poczta.pl", "123456789012@x.org"):
        for before, after in (("", ""), ("Write to ", " now"), ("<", ">,  or"), ("12345678901 ", "\n\nend"), ("@", "")):
            text = before + address + after
            edits = token_counts.rule_edits(text)
            assert [(text[a:b], new) for a, b, new in edits if "@" in text[a:b]] == [(address, "<email>")]
            edited = text
            for a, b, new in reversed(edits):
                edited = edited[:a] + new + edited[b:]
            doc, n, done, skipped = token_counts.apply_edits(text, edits, splitter)
            assert (doc.text, doc.tree.total, n) == (edited, len(enc.encode_ordinary(edited)), len(enc.encode_ordinary(text)))
            assert (done, skipped) == (len(edits), 0)
            found += 1
    assert found == 35
    assert token_counts.rule_edits("no address @ here, x@y nor a@ b.de") == []
    plain = re.compile(token_counts._EDITS.pattern[token_counts._EDITS.pattern.index(r"[\w.%+-]+@") :])
    random.seed(8)
    for _ in range(20000):
        text = "".join(random.choice(["a", "b1", "@", "@", ".", "+", "-", "%", "_", " ", "1234567890", "x.de"]) for _ in range(random.randrange(14)))
        assert [m.span() for m in token_counts._EDITS.finditer(text)] == [m.span() for m in plain.finditer(text)]


def test_toxicity_reads_words_to_their_end(spark):
    """Words that share their first 13 letters and differ after them."""
    docs, labels = _training(lambda i, toxic: [["verantwortungslosen", "verantwortungstrottel"][toxic]])
    ordinary, toxic = _scores(spark, docs, labels, ["verantwortungslose", "verantwortungstrotteln"])
    assert toxic > 0.5 > ordinary
    keys, shorter, sizes = toxicity.starts(["w" * 5000, "", "ab"])
    assert sizes.tolist() == [5001, 1, 3] and len(set(keys.tolist())) == 5001 + 1 + 3
    assert shorter[1:5001].tolist() == keys[:5000].tolist() and shorter[[0, 5001, 5002]].tolist() == [toxicity.EMPTY] * 3


def test_licenses_of_unmodified_texts(spark):
    asis = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR\nIMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,\nFITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE\nAUTHORS BE LIABLE.\n'
    mit = 'MIT License\n\nCopyright (c) 2020 A\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the "Software"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, and to permit persons to whom the Software is\nfurnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all\ncopies or substantial portions of the Software.\n\n' + asis
    bsd2 = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this\n   list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice,\n   this list of conditions and the following disclaimer in the documentation\n   and/or other materials provided with the distribution.\n\n"
    bsd3 = bsd2 + "3. Neither the name of the copyright holder nor the names of its\n   contributors may be used to endorse or promote products derived from\n   this software without specific prior written permission.\n"
    apache = 'Licensed under the Apache License, Version 2.0 (the "License");\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software\ndistributed under the License is distributed on an "AS IS" BASIS,\nWITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.\nSee the License for the specific language governing permissions.\n'
    gpl3 = "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.\n\nThis program is distributed in the hope that it will be useful,\nbut WITHOUT ANY WARRANTY; without even the implied warranty of\nMERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the\nGNU General Public License for more details.\n\nYou should have received a copy of the GNU General Public License\nalong with this program.  If not, see <https://www.gnu.org/licenses/>.\n"
    gpl2 = gpl3.replace("software: you", "software; you").replace("Foundation, either version 3", "Foundation; either version 2")
    wanted = {"MIT": mit, "BSD-2-Clause": bsd2, "BSD-3-Clause": bsd3, "BSD-2-Clause,BSD-3-Clause": bsd3 + "\nAnd the other part:\n\n" + bsd2, "Apache-2.0": apache, "GPL-3.0": gpl3, "LGPL-3.0": gpl3.replace("GNU General", "GNU Lesser General"), "": gpl3.replace("GNU General", "GNU Other")}
    rows = [(names, t) for names, t in [*wanted.items(), ("GPL-2.0", gpl2)]]
    forms = [lambda t: t, lambda t: "\n\n".join(p.replace("\n", " ") for p in t.split("\n\n")), lambda t: "\n".join(f" * {line}".rstrip() for line in t.split("\n")), lambda t: t.replace("\n", "\r\n")]
    cases = [(names, f(t)) for names, t in rows for f in forms]
    found = licenses.licenses(spark.createDataFrame([(i, t) for i, (_, t) in enumerate(cases)], "doc_id long, text string")).collect()
    assert {r.doc_id: r.licenses for r in found} == {i: names for i, (names, _) in enumerate(cases)}


def _passages(seed, n):
    random.seed(seed)
    base = ["".join(random.choice("abc") for _ in range(3)) for _ in range(400)]
    docs = []
    for i in range(n):
        w = []
        for _ in range(random.randrange(4)):
            a = random.randrange(300)
            w += base[a : a + random.randrange(90)] + [str(random.randrange(9))] * random.randrange(3)
        docs.append((i, " ".join(w)))
    return docs


def test_substring_dedup_shards_and_salted_groups(spark):
    """Many shards, and shards split into groups whose windows meet under a digest: the same rows."""
    docs = _passages(11, 80) + [(i, " ".join(f"hot{j}" for j in range(70)) + f" end{i}") for i in range(100, 160)] + [(i, " ".join(f"long{j}" for j in range(i, 900))) for i in (200, 260, 320)] + [(3, "other words for an id that is taken"), (None, "hot1 " * 60)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = ordered(substring_dedup.brute_force(docs))
    assert ordered(substring_dedup.substring_dedup(df, shard_phrases=5, group_words=300).collect()) == want
    assert ordered(substring_dedup.substring_dedup(df, shard_phrases=5).collect()) == want


def test_substring_dedup_removes_what_automata_locate(spark, monkeypatch):
    docs = _passages(12, 40)
    rows = [(d, 1, 0, b" ".join(t.encode().split())) for d, t in docs if len(t.split()) >= 50]
    words = [r[3].split() for r in rows]
    phrases = [b" ".join(w[i : i + 20]) for w in words for i in range(len(w) - 19)]
    assert substring_dedup.marks(rows, phrases, True, 50, 20).num_rows > 3
    assert substring_dedup.marks(rows, phrases, False, 50, 20).num_rows > 300
    monkeypatch.setattr(substring_dedup, "automaton", lambda phrases: ahocorasick_without_hits())
    assert substring_dedup.marks(rows, phrases, True, 50, 20).num_rows == 0


class ahocorasick_without_hits:
    def iter(self, stream):
        return iter(())


def test_licenses_with_own_tables(spark):
    """Short sentences of a caller's own table count; rules take their sentences in the order given; the brute force is the rule itself."""
    docs = spark.createDataFrame([(1, "MIT License\n\nx. a. b."), (2, "a. b. a. c."), (3, "c. a."), (4, None), (5, "")], "doc_id long, text string")
    own = {"mit license": "m", "a": "A", "b": "B", "c": "C"}
    rules = (("long", ("A", "B", "C")), ("pair", ("A", "B")), ("one", ("A",)), ("m", ("m",)))
    found = {r.doc_id: (r.n_sentences, r.sequence, r.licenses) for r in licenses.licenses(docs, own, rules).collect()}
    assert found == {1: (3, "m A B", "m,pair"), 2: (4, "A B A C", "long,one"), 3: (2, "C A", "one"), 4: (0, "", ""), 5: (0, "", "")}
    assert [r.licenses for r in licenses.licenses(docs, {}, ()).collect()] == [""] * 5


def test_license_notices(spark):
    table = licenses.sentence_table()
    assert len(table) > 1000 and all(k == licenses.normalised(k) for k in table)
    cases = {"SPDX-License-Identifier: GPL-2.0-or-later": "GPL-2.0", "This project is licensed under the MIT License.": "MIT", "Released under the Mozilla Public License, version 2.0": "MPL-2.0", "Licensed under CC BY-NC-SA 4.0.": "CC-BY-NC-SA-4.0", "the license of cars": ""}
    docs = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    assert {r.doc_id: r.licenses for r in licenses.licenses(docs).collect()} == dict(enumerate(cases.values()))


def test_toxicity_brute_force_kneser_ney(spark):
    """Word evidence against plain dictionaries of all starts and of all orders of the shared model."""
    from collections import Counter, defaultdict
    from math import log

    order, cut = 4, toxicity.DISCOUNT
    random.seed(13)
    docs = [(i % 2, " ".join("".join(random.choice("abÑ"[: 2 + i % 2]) for _ in range(random.randrange(1, 7))) for _ in range(9))) for i in range(24)]
    corpus = [t for _, t in docs] + ["ba ab bab", "zz top"]
    types = [{g for t in corpus for w in toxicity.words(t) for g in toxicity.grams(w, order)}]
    levels = {}
    for k in range(order - 1, 0, -1):
        levels[k] = Counter(g[1:] for g in types[-1])
        types.append(set(levels[k]))

    def shared(g):
        if not g:
            return 1 / toxicity.ALPHABET
        counts = {x: n for x, n in levels[len(g)].items() if x[:-1] == g[:-1]}
        total, back = sum(counts.values()), shared(g[1:])
        return (max(counts.get(g, 0) - cut, 0) + cut * len(counts) * back) / total if total else back

    n = {label: Counter(s for lab, t in docs if lab == label for w in toxicity.words(t) for s in (f"{w}$"[: i + 1] for i in range(len(w) + 1))) for label in (0, 1)}
    after = {label: defaultdict(list) for label in n}
    for label, counts in n.items():
        for start, c in counts.items():
            after[label][start[:-1]].append(c)

    def weight(label, context):
        found = after[label].get(context)
        return cut * len(found) / sum(found) if found else 1.0

    def p(label, start):
        context, tail = start[:-1], start[-(order - 1) :]
        found = after[label].get(context)
        own = max(n[label][start] - cut, 0) / sum(found) if found else 0.0
        return own + weight(label, context) * shared("^" * (order - 1 - len(tail)) + tail)

    def evidence(word):
        out, whole = 0.0, word + "$"
        for i in range(len(whole)):
            if whole[: i + 1] not in n[0] and whole[: i + 1] not in n[1]:
                known = whole[:i] in after[0] or whole[:i] in after[1]
                return out + (log(weight(1, whole[:i]) / weight(0, whole[:i])) if known else 0.0)
            out += log(p(1, whole[: i + 1]) / p(0, whole[: i + 1]))
        return out

    counts = toxicity.class_counts(spark.createDataFrame(docs, "label int, text string"), order)
    grams = toxicity.counted(spark.createDataFrame([(0, t) for t in corpus], "label int, text string"), lambda w: toxicity.grams(w, order))
    from pyspark.sql import functions as F

    model = toxicity.Model.of(counts, toxicity.shared_model(grams, counts.select(F.col("tail").alias("gram")).distinct(), order))
    probes = sorted({w for _, t in docs for w in toxicity.words(t)}) + ["q", "abq", "aaaaaaaaaa", "ñ", "ba"]
    assert np.allclose(model.evidence(probes), [evidence(w) for w in probes], atol=1e-9)


def test_trees_brute_force():
    """Histogram trees against a search over all rows of each node, and their arrays against a walk."""
    rng = np.random.default_rng(3)
    x = rng.integers(0, 9, (70, 3)).astype(float)
    y = ((x[:, 0] > 4) ^ (x[:, 2] > 6)).astype(float)
    trees = quality_classifier.Trees(trees=4, depth=2, bins=16, least=4).fit(x, y)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, 17)[1:-1], method="lower")) for j in range(3)]
    raw, base = np.full(70, trees.base), trees.base
    for t in range(4):
        prob = 1 / (1 + np.exp(-raw))
        g, h = prob - y, prob * (1 - prob)
        gain = lambda rows: g[rows].sum() ** 2 / (h[rows].sum() + trees.ridge)
        groups = [np.arange(70)]
        for level in range(2):
            split = []
            for i, rows in enumerate(groups):
                best = (1e-9, 0, np.inf)
                for j in range(3):
                    for c in cuts[j]:
                        left, right = rows[x[rows, j] <= c], rows[x[rows, j] > c]
                        if min(len(left), len(right)) >= trees.least and (v := gain(left) + gain(right) - gain(rows)) > best[0] + 1e-9:
                            best = (v, j, c)
                at = 2**level - 1 + i
                assert (trees.threshold[t, at], trees.feature[t, at] if best[2] < np.inf else 0) == (best[2], best[1])
                split += [rows[x[rows, best[1]] <= best[2]], rows[x[rows, best[1]] > best[2]]]
            groups = split
        for leaf, rows in enumerate(groups):
            value = -trees.rate * g[rows].sum() / (h[rows].sum() + trees.ridge)
            assert abs(trees.leaf[t, leaf] - value) < 1e-12
            raw[rows] += value
    walked = []
    for row in x:
        total = base
        for t in range(4):
            at = 0
            while at < 3:
                at = 2 * at + 1 + int(row[trees.feature[t, at]] > trees.threshold[t, at])
            total += trees.leaf[t, at - 3]
        walked.append(1 / (1 + np.exp(-total)))
    assert np.allclose(trees.scores(x), walked) and np.allclose(raw, [np.log(p / (1 - p)) for p in walked])
