"""Operators 11 to 13 against their brute-force versions."""

import hashlib
import random

import numpy as np
import pytest

from lattica.llm import chosen_path, filter_audit, token_alignment
from lattica.llm.words import mix


def key(row):
    return tuple((x is None, x if x is not None else 0) for x in row)


def ordered(rows):
    return sorted(map(tuple, rows), key=key)


def near_copies(seed, n_groups=40):
    """Documents in groups of near copies around the threshold, with chains, short texts, repeated ids and a passage in many."""
    random.seed(seed)
    docs, passage = [], [f"p{i}" for i in range(30)]
    for _ in range(n_groups):
        base = [random.choice("abcdefghij") + str(random.randrange(50)) for _ in range(random.choice([1, 2, 3, 5, 8, 12, 25, 40, 80]))]
        if random.random() < 0.4:
            base += passage
        w = base
        for _ in range(7):
            w = list(w if random.random() < 0.5 else base)
            for _ in range(random.randrange(4)):
                k, i = random.randrange(3), random.randrange(len(w)) if w else 0
                if k == 0 and w:
                    w[i] = f"x{random.randrange(9)}"
                elif k == 1 and w:
                    del w[i]
                else:
                    w.insert(i, f"y{random.randrange(9)}")
            docs.append((len(docs) if random.random() < 0.95 else None, " ".join(w) if random.random() < 0.8 else " ".join(w).upper()))
    return docs + [(d, docs[(i * 7 + 50) % len(docs)][1]) for i, (d, _) in enumerate(docs[:30])]


def test_chosen_path_brute_force(spark, monkeypatch):
    docs = near_copies(4)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = ordered(chosen_path.brute_force(docs))
    assert sum(r[0] != r[2] for r in want) > 100
    assert ordered(chosen_path.similar_classes(df).collect()) == want
    # Trees that branch to the bottom, and cells of few documents.
    for name, value in {"LEAF": 2, "FEW": 0, "BLOCK": 3, "PROBES": 4, "CELL_BYTES": 1500}.items():
        monkeypatch.setattr(chosen_path, name, value)
    assert ordered(chosen_path.similar_classes(df).collect()) == want


def test_chosen_path_awkward_rows(spark, awkward, empty):
    want = ordered(chosen_path.brute_force([(r.doc_id, r.text) for r in awkward.collect()]))
    assert ordered(chosen_path.similar_classes(awkward).collect()) == want
    assert (3, 0, 3, True) in want and (None, 10, 1, False) in want and [r for r in want if r[0] == 1] == [(1, 10, 1, True)] * 2
    assert chosen_path.similar_classes(empty).collect() == []
    lone = spark.createDataFrame([(None, "a b c d"), (None, "a b c d"), (None, None)], "doc_id long, text string")
    assert ordered(chosen_path.similar_classes(lone).collect()) == [(None, 0, None, True), (None, 2, None, True), (None, 2, None, True)]


def test_signatures_and_recall():
    """Signatures estimate the similarity; trees as simulated keep a pair as often as recall_of says."""
    rng = np.random.default_rng(3)
    pool = mix(np.arange(1, 4001, dtype=np.uint64))
    agree, met, trials = [], 0, 150
    for _ in range(trials):
        own = rng.permutation(pool)[:540]
        a, b = np.sort(own[:500]), np.sort(np.concatenate([own[40:500], own[500:540]]))  # 460 of 540
        values = chosen_path.signatures([a, b])
        agree.append(int((values[0] == values[1]).sum()))
        paths = chosen_path.first_children(values)
        alive = np.unique(paths[0][:2][paths[0][:2] == paths[1][:2]])  # the first tree
        for level in range(2, chosen_path.DEPTH + 1):
            if len(alive):
                both = [chosen_path.children(alive.view(np.int64), np.repeat(v[None, :], len(alive), axis=0), level)[0] for v in values]
                alive = np.intersect1d(*both).view(np.uint64)
        met += bool(len(alive))
    similarity = 460 / 540
    assert abs(np.mean(agree) / chosen_path.WIDTH - similarity) < 0.03
    assert met / trials > chosen_path.recall_of(similarity, 1) - 0.12
    assert 1 - chosen_path.recall_of(0.85) < 1e-6
    assert np.array_equal(chosen_path.unpacked(chosen_path.packed(values)), values)


def test_sketches_bound_differences():
    """A sketch never calls a linked pair unlinked, whatever the sizes."""
    rng = np.random.default_rng(5)
    pool = mix(np.arange(1, 9001, dtype=np.uint64))
    kept = refused = 0
    for _ in range(300):
        own = rng.permutation(pool)[: rng.integers(1, 3000)]
        a, b = np.sort(own), np.sort(rng.permutation(own)[: max(1, int(len(own) * rng.uniform(0.6, 1)))])
        sketches = [np.frombuffer(chosen_path.sketch_of(x), dtype=np.uint64) for x in (a, b)]
        differ = chosen_path.apart(sketches[0], sketches[1][None])[0]
        assert differ <= len(a) - len(b) and differ == chosen_path.apart(sketches[1], sketches[0][None])[0]
        may = bool(chosen_path.may_link(len(a), len(b), differ))
        assert may or 100 * len(b) < chosen_path.LEVEL * len(a)
        kept, refused = kept + may, refused + (not may)
    assert kept > 50 and refused > 50


def test_token_alignment_brute_force(spark, awkward):
    random.seed(8)
    words = ["the", "naïve", "日本", "\U0001f600", "don't", "  ", "\n", "á", "x" * 90, "<|endoftext|>", "<s>", "1234567", "ß", "\t", "=" * 30, "word", "e f"]
    docs = [(i if i % 9 else None, random.choice(["", " "]) + random.choice([" ", "  ", ""]).join(random.choice(words) for _ in range(random.randrange(25)))) for i in range(300)]
    docs += [(400 + i, t + "▁") for i, (_, t) in enumerate(docs[:30])]  # B gives the mark of a space back as a space
    docs += [(0, None), (1, ""), (2, " "), (3, "a" * 5000 + "é" * 3000), (4, "word " * 3000), (4, "word " * 3000)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = ordered(token_alignment.brute_force(docs))
    assert 30 < sum(r[1] == 0 for r in want) < 100
    for hot in (token_alignment.HOT, 20, 0):
        assert ordered(token_alignment.token_alignment(df, hot=hot).collect()) == want
    assert ordered(token_alignment.token_alignment(awkward).collect()) == ordered(token_alignment.brute_force([(r.doc_id, r.text) for r in awkward.collect()]))


def test_token_alignment_of_an_empty_table(spark, empty):
    assert token_alignment.token_alignment(empty).collect() == []
    nothing = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert ordered(token_alignment.token_alignment(nothing).collect()) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_token_alignment_groups(spark):
    """The groups as text are those that the digest is of; texts align alone as in a batch."""
    align = token_alignment.Aligner().align
    some = ["Unaligned tokenizers: naïve cafés, 12345 items", "", "日本語 text", "x"]
    which, found = align(some)
    assert which == [0, 2, 3]
    for i, text in zip(which, found.groups):
        one = align([some[i]])[1]
        assert one.groups == [text] and one.counts.tolist() == [found.counts[which.index(i)].tolist()]
    rows = token_alignment.alignments(spark.createDataFrame(list(enumerate(some)), "doc_id long, text string"), groups=True).orderBy("doc_id").collect()
    assert [r.groups for r in rows if r.n_a] == found.groups and [len(r.pairs) for r in rows if r.n_a] == found.sizes.tolist()
    assert all(r.groups_sha256 == (hashlib.sha256(r.groups.encode()).hexdigest() if r.n_a else "") for r in rows)


def test_bitset_ranks():
    rng = np.random.default_rng(1)
    for _ in range(50):
        lengths = rng.integers(1, 9, rng.integers(1, 200))
        bits = token_alignment.marked(lengths, int(lengths.sum()))
        ends = np.cumsum(lengths) - 1
        assert np.array_equal(token_alignment.selected(bits), ends)
        assert np.array_equal(token_alignment.ranks(bits, ends), np.arange(1, len(lengths) + 1))


def audit_rows(df):
    columns = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    return sorted(map(tuple, df.select(*columns).collect()))


def test_filter_audit_brute_force(spark, awkward, empty, some_labels):
    random.seed(9)
    texts = ["", None, " ", "$", "A" * 300] + [" ".join(random.choice(["w", "W", "v", "u", f"t{random.randrange(99)}"]) for _ in range(n)) + e for n in (3, 49, 50, 51, 120) for e in ("", " #", " B")]
    docs = [(random.choice([None, *range(40)]), random.choice(texts), random.choice(["s", "t", "", None])) for _ in range(200)]
    labels = [(d, q, t) for d in range(40) for q, t in [(random.choice([0, 1, None]), random.choice([0, 1, None]))]] + [(3, 1, 1), (None, 1, 1)]
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert audit_rows(filter_audit.filter_audit(spark.createDataFrame(docs, "doc_id long, text string, source string"), marks)) == sorted(filter_audit.brute_force(docs, labels))
    rows = [(r.doc_id, r.text, r.source) for r in awkward.collect()]
    assert audit_rows(filter_audit.filter_audit(awkward, some_labels)) == sorted(filter_audit.brute_force(rows, [tuple(r) for r in some_labels.collect()]))
    assert filter_audit.filter_audit(empty, some_labels).collect() == []


@pytest.mark.parametrize("filters", ["A", "AB", "ABC"])
def test_interactions_of_other_filters(spark, filters):
    """Shapley values sum to the removed documents times the orders, whatever the filters."""
    cells = spark.createDataFrame([("p", m, m + 1, 0, m) for m in range(1 << len(filters))], "part string, mask int, n long, good long, toxic long")
    rows = filter_audit.interactions(cells, filters).collect()
    orders = {r.filter_order for r in rows}
    failing = sum(m + 1 for m in range(1, 1 << len(filters)))
    assert len(rows) == len(orders) * len(filters)
    assert sum({r.filter_order[r.step - 1]: r.shapley for r in rows}.values()) == failing * len(orders)
    assert all(r.kept == 1 for r in rows if r.step == len(filters))


def test_repeated_ids_do_not_add_to_a_sample(spark):
    """20,000 rows of 20 ids give 20 rows to learn from, whatever their order."""
    from lattica.llm.labelled import one_row, sample

    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    docs = spark.range(20000).selectExpr("id % 20 AS doc_id", "cast((id * 7919) % 1000 AS double) AS a", "cast(id % 3 AS double) AS b")
    joined = docs.join(sample(labels, "quality", 50), "doc_id")
    rows = one_row(joined, "a", "b").collect()
    assert len(rows) == joined.select("doc_id").distinct().count() < 20
    assert sorted(rows) == sorted(one_row(joined.repartition(5, "b"), "a", "b").collect())
    least = {r.doc_id: (r.a, r.b) for r in rows}
    assert all((r.a, r.b) >= least[r.doc_id] for r in joined.collect())


def test_license_notices_of_several_kinds(spark):
    """Holders' names, versions, pointers to a file, several licences, SPDX expressions."""
    from lattica.llm import licenses

    bsd = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\nRedistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\nRedistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n"
    names = "Neither the name of Google Inc. nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
    gpl = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version.\n\nThis program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty.\n\nYou should have received a copy of the GNU General Public License along with this program. If not, see the address."
    lgpl = "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.\n\nThis library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;\n\nYou should have received a copy of the GNU Lesser General Public License along with this library."
    cases = {
        bsd + names: "BSD-3-Clause",
        bsd: "BSD-2-Clause",
        gpl.format(2): "GPL-2.0",
        gpl.format(3): "GPL-3.0",
        lgpl: "LGPL-2.1",
        "This project is licensed under the MIT License - see the LICENSE file for details.": "MIT",
        "This project is licensed under the MIT License - see the LICENSE.md file for details": "MIT",
        "Licensed under the Apache License 2.0, see LICENSE.": "Apache-2.0",
        "This crate is dual licensed under the MIT license or the Apache License 2.0.": "Apache-2.0,MIT",
        "Licensed under either of the MIT License or the Apache License 2.0": "Apache-2.0,MIT",
        "It is licensed under the MIT license and the moon": "",
        "// SPDX-License-Identifier: MIT OR Apache-2.0": "Apache-2.0,MIT",
        "# SPDX-License-Identifier: MIT": "MIT",
        "SPDX-License-Identifier: (GPL-2.0-only WITH Classpath-exception-2.0) OR MIT": "GPL-2.0,MIT",
        "SPDX-License-Identifier: LicenseRef-own": "",
        "Apache-2.0": "",
    }
    rows = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    got = {r.doc_id: r.licenses for r in licenses.licenses(rows).collect()}
    assert {t: got[i] for i, t in enumerate(cases)} == cases
