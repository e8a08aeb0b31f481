"""Language, licences, URLs and quality: held-out accuracy, brute force and edge cases."""

import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import language_id as L
from tidemark.llm import license_scan, queries, url_filter
from tidemark.llm import quality_rules as Q
from tidemark.llm.common import table

SF = "/root/testdata/sf0.01"


def test_gradients_are_those_of_finite_differences():
    rng = np.random.default_rng(2)
    model = L._start(["a", "b"], 3, 1)
    for name in ("embed", "recur", "out", "bias"):
        setattr(model, name, getattr(model, name).astype(np.float64))
    data = rng.integers(0, 255, (3, 7)).astype(np.int32)
    data[1, 4:] = L.PAD
    label = np.array([0, 1, 1])
    _, grads = L.gradients(model, data, label)
    for p, g in zip((model.embed, model.recur, model.out, model.bias), grads):
        for at in [tuple(rng.integers(0, n) for n in p.shape) for _ in range(6)]:
            if p.ndim == 3 and p.shape[1] == L.PAD + 1:
                at = (at[0], int(data[0, at[2] % 7]), at[2])
            was = p[at]
            p[at] = was + 1e-2
            up, _ = L.gradients(model, data, label)
            p[at] = was - 1e-2
            down, _ = L.gradients(model, data, label)
            p[at] = was
            assert abs((up - down) / 2e-2 - g[at]) < 2e-3


def test_language_accuracy_and_edges(spark):
    got = queries.op1_language_id(spark, SF).collect()
    true = {r["doc_id"]: r["lang"] for r in table(spark, SF, "documents").select("doc_id", "lang").collect()}
    held = [r for r in got if r["held_out"]]
    assert len(got) == len(true)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert np.mean([r["lang_pred"] == true[r["doc_id"]] for r in held]) > 0.97
    model = L.train([b"the cat and the dog " * 6, "là où été çà ".encode() * 6] * 30, ["en", "fr"] * 30, epochs=4)
    rows = [(1, None), (2, ""), (3, "12 ... !"), (4, "日"), (5, "the dog " * 50_000), (None, "x")]
    df = spark.createDataFrame([(i, t, "clash", 0.5) for i, t in rows], "doc_id long, text string, lang_pred string, score double")
    out = {r["doc_id"]: r for r in L.identify(df, model).collect()}
    assert [out[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3 and out[1]["score"] == 0
    assert out[4]["lang_pred"] != "und" and out[5]["lang_pred"] == "en" and 0.5 < out[5]["score"] <= 1
    assert L.identify(df.limit(0), model).count() == 0
    assert {r["lang_pred"] for r in L.identify(df, L.fit(df.withColumn("lang", F.lit(None).cast("string")))).collect()} == {"und"}


def test_language_sample_is_bounded(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 400).alias("text"), F.when(F.col("id") % 10 == 0, "a").otherwise("b").alias("lang"))
    windows, labels = L.sample(df, per_language=20)
    assert set(Counter(labels)) == {"a", "b"} and max(Counter(labels).values()) <= 20 * L.WINDOWS


def test_every_language_is_learnt(spark, monkeypatch):
    """Also rare ones; many languages share the bound on rows."""
    monkeypatch.setattr(L, "ROWS", 1000)
    lang = F.when(F.col("id") < 3000, "common").when(F.col("id") == 3999, "rare").otherwise(F.concat(F.lit("l"), F.col("id") % 98))
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("words "), F.col("id")).alias("text"), lang.alias("lang"), F.lit(1).alias("_share"))
    counts = Counter(L.sample(df)[1])
    assert len(counts) == 100 and counts["rare"] == 1
    assert max(counts.values()) <= 10


def test_licences(spark):
    s = license_scan.SENTENCES
    mit = "MIT License\n\n" + ". ".join(s[k] for k in ("mit-grant", "mit-notice", "mit-as-is", "mit-liability")) + "."
    rows = [
        (1, None),
        (2, ""),
        (3, "Code. Released under the MIT License.\nMore"),
        (4, mit),
        (5, "Licensed under the Apache License, Version 2.0. licensed UNDER   cc by-nc 4.0!"),
        (6, s["gpl-free"] + ": " + s["gpl-redistribute-3"] + "."),
        (7, s["gpl-redistribute-3"] + "."),
        (8, "Not Released under the MIT License at all."),
        (9, "Released under the MIT License.\n" * 2),
        (None, "x" * 200_000 + ".\nMPL"),
    ]
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id long, text string, licenses string, place int")
    out = {r["doc_id"]: r for r in license_scan.scan(df).collect()}
    assert {i: out[i]["licenses"] for i in out} == {
        1: [], 2: [], 3: ["MIT"], 4: ["MIT"], 5: ["Apache-2.0", "CC-BY-NC-4.0"], 6: ["GPL-3.0-or-later"], 7: ["GPL-3.0-or-later"], 8: [], 9: ["MIT"], None: [],
    }
    assert out[3]["first_sentence"] == 1 and out[1]["first_sentence"] is None
    assert out[4]["sentence_ids"] == ["mit-title-mit", "mit-grant", "mit-notice", "mit-as-is", "mit-liability"]
    assert out[6]["sentence_ids"] == ["gpl-free", "gpl-redistribute-3"]
    assert license_scan.scan(df.limit(0)).count() == 0


MIT_HEADER = """/*
 * The MIT License
 *
 * Copyright (c) 2020 Somebody
 *
 * Permission is hereby granted, free of charge, to any person obtaining a copy
 * of this software and associated documentation files (the "Software"), to deal
 * in the Software without restriction, including without limitation the rights
 * to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
 * copies of the Software, and to permit persons to whom the Software is
 * furnished to do so, subject to the following conditions:
 */"""
GPL_HEADER = """# This program is free software; you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation; either version 2 of the License, or
# (at your option) any later version.
"""
MPL_HEADER = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at http://mozilla.org/MPL/2.0/."""


def test_licences_as_they_are_written(spark):
    """Expectations by hand: wrapped, commented, with titles, and what only looks like a part."""
    want = {
        MIT_HEADER: (["mit-title", "mit-grant"], ["MIT"]),
        GPL_HEADER: (["gpl-free", "gpl-redistribute", "version-2-later"], ["GPL-2.0-or-later"]),
        MPL_HEADER: (["mpl-subject"], ["MPL-2.0"]),
        "Version notes\n2.0\nmore": ([], []),
        "Released v. 2.0": ([], []),
        "2.0": ([], []),
        "Licensed under the MIT\nLicense.": (["mit-licensed"], ["MIT"]),
        "MIT License\nCopyright (c) 2020 Somebody": (["mit-title-mit"], ["MIT"]),
        "MIT License\nReleased under the\nMIT License.": (["mit-title-mit", "mit-released"], ["MIT"]),
        "// SPDX-License-Identifier: Apache-2.0\nint main();": (["spdx-Apache-2.0"], ["Apache-2.0"]),
        "# SPDX-License-Identifier: MIT OR Apache-2.0": ([], []),
        "GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007\n\nPreamble": (["gpl-title", "title-version-3"], ["GPL-3.0-only"]),
        "                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/": (["apache-title", "apache-title-version"], ["Apache-2.0"]),
        "one word\n" * 300 + "Released under the\nMIT License": (["mit-released"], ["MIT"]),
        "Released under the MIT License\r\n\r\nNext": (["mit-released"], ["MIT"]),
    }
    df = spark.createDataFrame(list(enumerate(want)), "doc_id long, text string")
    got = {r["doc_id"]: (r["sentence_ids"], r["licenses"]) for r in license_scan.scan(df).collect()}
    assert got == dict(enumerate(want.values()))
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(want)))
    rows = con.sql(license_scan.sql()).fetchall()
    assert {r[0]: (r[2], r[3]) for r in rows} == {k: (",".join(a), ",".join(b)) for k, (a, b) in enumerate(want.values())}


def test_every_rule_names_known_sentences():
    known = set(license_scan.KNOWN.values())
    assert len(known) == len(license_scan.SENTENCES)
    assert all(x in known for _, ids in license_scan.RULES for x in ids)
    assert all(len([p for p in re.split(license_scan.BREAK, license_scan.normal(x)) if p]) == 1 for x in license_scan.SENTENCES.values())


def brute_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    m = re.match(r"(?s)([^/?#]*)([^?#]*)", rest)
    return re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]


def brute_rule(host, path):
    best = None
    for verdict, rule in queries.URL_RULES:
        domain, _, start = rule.partition("/")
        if (host == domain or host.endswith("." + domain)) and path.startswith("/" + start) and (best is None or len(rule) > len(best[1])):
            best = verdict, rule
    return best


def test_urls_and_rules(spark):
    urls = [None, "", "no scheme", "http://", "://", "http://COM", "http://com/", "http://a.example.com/en/1?x#y", "http://www.example.com/en/", "http://xexample.com/en/", "http://example.com/EN/", "http://É.example.net/fr/1", "http://b.net/es", "http://b.net/es/", "x://y://z/a", "http://h?x/y", "http://h#://", "http://h/a\nb?c", "http://org/en/" + "a/" * 3000]
    df = spark.createDataFrame([(i, u, "clash", 1) for i, u in enumerate([*urls, *urls])], "page_id long, url string, host string, labelled int")
    out = url_filter.judge(df, queries.URL_RULES).collect()
    assert Counter(r["page_id"] for r in out) == Counter(range(2 * len(urls)))
    for r in out:
        url = [*urls, *urls][r["page_id"]]
        assert (r["host"], r["path"]) == brute_url(url)
        rule = brute_rule(r["host"], r["path"])
        assert r["rule"] == (rule[1] if rule else None)
        assert r["verdict"] == (rule[0] if rule else "allow")
    assert url_filter.judge(df.limit(0), queries.URL_RULES).count() == 0


def test_templates_of_bad_pages_are_blocked(spark):
    pages, labels = [], []
    for k in range(200):
        pages += [(4 * k, f"http://shop.org/ad/{k}.html"), (4 * k + 1, f"http://shop.org/wiki/page{k}"), (4 * k + 2, f"http://many.org/word{chr(97 + k % 26)}{'x' * (k // 26)}/a")]
        labels += [(4 * k, k % 10 != 0), (4 * k + 1, k % 10 == 0), (4 * k + 2, False)] if k % 2 else []
    labels += [(0, None), (0, True), (None, True), (99_999, True)]
    df = spark.createDataFrame(pages, "page_id long, url string")
    out = url_filter.judge(df, [], spark.createDataFrame(labels, "page_id long, bad boolean")).collect()
    by = {(r["host"], r["template"], r["verdict"]) for r in out}
    assert by == {("shop.org", "/ad/<n>.html", "block"), ("shop.org", "/wiki/page<n>", "allow"), ("many.org", "/<*>/a", "allow")}


def stands_out(n, b, all_n, all_b, tested):
    gain = lambda k, m: (k * math.log(k * all_n / (m * all_b)) if k else 0) + ((m - k) * math.log((m - k) * all_n / (m * (all_n - all_b))) if m - k else 0)
    return n > 0 and 0 < all_b < all_n and gain(b, n) + gain(all_b - b, all_n - n) > math.log(tested * 2 / url_filter.CHANCE)


def brute_names(branches):
    """Names for ``{segment: (labelled, bad)}``, branch after branch."""
    all_n, all_b = sum(n for n, _ in branches.values()), sum(b for _, b in branches.values())
    tested = sum(n > 0 for n, _ in branches.values())
    apart = [s for s, (n, b) in branches.items() if stands_out(n, b, all_n, all_b, tested)]
    clusters = []
    for s in sorted(apart, key=lambda s: (branches[s][1] / branches[s][0], branches[s], s)):
        n, b = branches[s]
        if clusters and url_filter._alike(clusters[-1][1], clusters[-1][2], n, b):
            names, m, c = clusters[-1]
            clusters[-1] = ([*names, s], m + n, c + b)
        else:
            clusters.append(([s], n, b))
    out = {s: s if len(names) == 1 else f"{{{min(names)}|+{len(names) - 1}}}" for names, _, _ in clusters for s in names}
    rest = [s for s in branches if s not in out]
    return out | {s: s if len(rest) == 1 else "<*>" for s in rest}


def brute_tree(rows, path=()):
    """Templates of a host for ``{segments: (labelled, bad)}``, branch after branch and segment after segment."""
    out = {segs: path for segs, rest in rows if not rest}
    rows = [x for x in rows if x[1]]
    if not rows:
        return out
    if not out and len({rest[0] for _, rest in rows}) == 1:  # all go on alike
        return brute_tree([(segs, rest[1:]) for segs, rest in rows], (*path, rows[0][1][0]))
    branches = {}
    for segs, rest in rows:
        n, b = branches.get(rest[0], (0, 0))
        branches[rest[0]] = (n + COUNTS[segs][0], b + COUNTS[segs][1])
    names = brute_names(branches)
    for name in set(names.values()):
        out |= brute_tree([(segs, rest[1:]) for segs, rest in rows if names[rest[0]] == name], (*path, name))
    return out


COUNTS = {}


def test_one_rule_at_every_width(spark):
    """A branch of ten labels, six bad, among others of three: told apart neither from 31 others nor from 32."""
    for width in (2, 31, 32, 33, 40):
        pages, labels = [], []
        for k in range(width):
            for j in range(10):
                pages.append((10 * k + j, f"http://h.org/{chr(97 + k % 26)}{'x' * (k // 26)}/p"))
                labels.append((10 * k + j, j < (6 if k == 0 else 3)))
        out = url_filter.judge(spark.createDataFrame(pages, "page_id long, url string"), [], spark.createDataFrame(labels, "page_id long, bad boolean")).collect()
        assert {(r["template"], r["verdict"]) for r in out} == {("/<*>/p", "allow")}, width


@pytest.mark.parametrize("seed", range(3))
def test_whole_tree_against_brute_force(spark, seed):
    rng = random.Random(seed)
    pages, labels = [], []
    for i in range(1500):
        host = rng.choice(["a.org", "b.org"])
        parts = [rng.choice(["x", "y", "z", "w" + chr(97 + rng.randrange(20))]) for _ in range(rng.randint(0, 4))]
        pages.append((i, f"http://{host}/{'/'.join(parts)}"))
        if rng.random() < 0.7:
            labels.append((i, rng.random() < (0.9 if parts[:1] == ["x"] or parts[1:2] == ["wa"] else 0.2)))
    df = spark.createDataFrame(pages, "page_id long, url string")
    out = url_filter.judge(df, [], spark.createDataFrame(labels, "page_id long, bad boolean")).collect()
    bad = dict(labels)
    seen = Counter()
    for host in ("a.org", "b.org"):
        own = [(i, tuple(u.split("/", 3)[3].split("/"))) for i, u in pages if u.startswith(f"http://{host}/")]
        COUNTS.clear()
        for i, segs in own:
            n, b = COUNTS.get(segs, (0, 0))
            COUNTS[segs] = (n + (i in bad), b + bad.get(i, False))
        want = {segs: "/" + "/".join(t) for segs, t in brute_tree([(segs, segs) for segs in COUNTS]).items()}
        sums = {}
        for segs, t in want.items():
            n, b = sums.get(t, (0, 0))
            sums[t] = (n + COUNTS[segs][0], b + COUNTS[segs][1])
        whole = (sum(bad.values()) + 1) / (len(bad) + 2)
        of_host = [bad[i] for i, _ in own if i in bad]
        share = (sum(of_host) + url_filter.SMOOTHING * whole) / (len(of_host) + url_filter.SMOOTHING)
        got = {r["page_id"]: r for r in out}
        for i, segs in own:
            n, b = sums[want[segs]]
            purity = (b + url_filter.SMOOTHING * share) / (n + url_filter.SMOOTHING)
            blocked = n >= url_filter.LEAST and purity >= url_filter.PURITY
            assert got[i]["template"] == want[segs], (segs, COUNTS[segs])
            assert got[i]["purity"] == pytest.approx(purity) and got[i]["verdict"] == ("block" if blocked else "allow")
            seen[got[i]["verdict"]] += 1
    assert min(seen["block"], seen["allow"]) > 100


def test_wide_nodes_keep_what_stands_out(spark):
    pages, labels = [], []
    for k in range(60):
        for j in range(20):
            i = 20 * k + j
            pages.append((i, f"http://wide.org/{chr(97 + k % 26)}{'x' * (k // 26)}/p"))
            if k < 50:
                labels.append((i, (j < 18) if k in (7, 8) else j == 0))
    for k in range(100):  # one page for each slug: nothing can be told of one alone
        pages.append((5000 + k, f"http://slug.org/{chr(97 + k % 26)}{'y' * (k // 26)}"))
        labels += [(5000 + k, k % 10 != 0)] if k < 90 else []
    df = spark.createDataFrame(pages, "page_id long, url string")
    out = {r["page_id"]: r for r in url_filter.judge(df, [], spark.createDataFrame(labels, "page_id long, bad boolean")).collect()}
    assert {i // 20 for i in out if i < 1200 and out[i]["verdict"] == "block"} == {7, 8}
    assert out[140]["template"] == "/{h|+1}/p" and out[0]["template"] == out[1199]["template"] == "/<*>/p"
    assert {(out[i]["template"], out[i]["verdict"]) for i in out if i >= 5000} == {("/<*>", "block")}


def test_deep_paths_are_told_apart(spark):
    pages, labels = [], []
    for k in range(40):
        for j, part in enumerate(("spam", "docs", "news/x/y/z/ad", "news/x/y/z/wiki")):
            pages.append((4 * k + j, f"http://deep.org/a/b/c/d/{part}/{k}"))
            labels += [(4 * k + j, (k % 10 != 0) == (j % 2 == 0))] if k % 2 else []
    pages += [(1000, "http://trap.org/a/b"), (1001, "http://trap.org/" + "x/" * 3000), (1002, "http://trap.org/" + "x/" * 2000), (1003, "http://trap.org")]
    df = spark.createDataFrame(pages, "page_id long, url string")
    out = {r["page_id"]: r for r in url_filter.judge(df, [], spark.createDataFrame(labels, "page_id long, bad boolean")).collect()}
    assert len(out) == len(pages)
    assert all(out[i]["verdict"] == ("block" if i % 2 == 0 else "allow") for i in range(160))
    assert out[0]["template"] == "/a/b/c/d/spam/<n>" and out[3]["template"] == "/a/b/c/d/news/x/y/z/wiki/<n>"
    assert out[1001]["verdict"] == "allow" and out[1000]["template"] == "/<*>/<*>"


def test_counts_are_merged_as_branches_are():
    """Branches with equal counts at once, or one after another."""
    rng = random.Random(3)
    for _ in range(200):
        counts = {(n := rng.randint(1, 60), rng.randint(0, n)): rng.randint(1, 3) for _ in range(rng.randint(1, 20))}
        found = url_filter.merge_counts([(*c, many) for c, many in counts.items()])
        single = url_filter.merge_counts([(*c, 1) for c, many in counts.items() for _ in range(many)])
        assert single == [k for k, many in zip(found, counts.values()) for _ in range(many)]


def brute_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dups = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dups += line in seen
            seen.add(line)
    often = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    repeat = {i + k for i in range(len(words) - 2) if often[tuple(words[i : i + 3])] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dups, len(repeat)


@pytest.mark.parametrize("block", [1 << 18, 5])
def test_counts_match_brute_force(monkeypatch, block):
    monkeypatch.setattr(Q, "BLOCK", block)
    rng = random.Random(block)
    texts = [None, "", " \n\x0b", "a b c a b c", "x\n\n\nx\n \n x", "é# é# é#\x85\xa0", "a a a a"]
    texts += ["".join(rng.choice("ab \n\t#é日") for _ in range(rng.randint(0, 80))) for _ in range(400)]
    for t in texts:
        assert Q.counts((t or "").encode()) == brute_counts(t), repr(t)


def test_scores_do_not_depend_on_blocks(monkeypatch):
    rng = np.random.default_rng(0)
    model = Q.Model(rng.standard_normal(Q.DIMENSIONS).astype(np.float32), 0.1, 1.0, 0.0)
    raw = "some words, of a text é and more ".encode() * 20
    place, value = Q.features(raw)
    whole = model.probability(raw)
    assert abs(whole - Q._sigmoid(float(model.weights[place] @ value) + 0.1)) < 1e-4
    monkeypatch.setattr(Q, "BLOCK", 7)
    assert abs(model.probability(raw) - whole) < 1e-6
    assert np.allclose(Q.features(raw)[1], value)


@pytest.mark.parametrize("block", [1 << 18, 5])
def test_runs_are_of_characters(monkeypatch, block):
    monkeypatch.setattr(Q, "BLOCK", block)
    half = Q.DIMENSIONS // 2

    def place(run):
        h = 0
        for k, c in enumerate(run):
            h = ord(c) if k == 0 else (h * 16777619 & 0xFFFFFFFF) ^ ord(c)
        return half + ((h * 2654435761 & 0xFFFFFFFF) >> 17)

    for text in ["", "abc", "日本é", "abcd", "日本語é", "plain words only " * 3, "né 日本語 \U0001f600 ab" * 5]:
        places, values = Q.features(text.encode())
        runs = Counter(place(text[i : i + Q.GRAM]) for i in range(len(text) - Q.GRAM + 1))
        got = {int(p): float(v) for p, v in zip(places, values) if p >= half}
        assert got == pytest.approx({p: 10 * n / (len(text) - Q.GRAM + 1) for p, n in runs.items()})


def test_quality(spark):
    out = {r["doc_id"]: r for r in queries.op9_quality_rules(spark, SF).collect()}
    labels = {r["doc_id"]: r["quality"] for r in table(spark, SF, "labels").collect()}
    judged = [(out[i]["kept"], q == 1) for i, q in labels.items() if i in out and not out[i]["base_failed"]]
    assert np.mean([a == b for a, b in judged]) > 0.95
    assert np.mean([a for a, good in judged if good]) > 0.97
    texts = {r["doc_id"]: r["text"] for r in table(spark, SF, "documents").collect()}
    for i, r in out.items():
        base = brute_counts(texts[i])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == base
        assert r["base_failed"] == (base[0] < 50 or 100 * base[4] > 50 * base[0])


def test_held_out_quality(spark):
    """Trained on half the labelled rows, held against the other half."""
    docs, labels = table(spark, SF.replace("0.01", "0.1"), "documents"), table(spark, SF.replace("0.01", "0.1"), "labels")
    model = Q.fit(docs, labels.where("doc_id % 2 = 0"), per_class=300)
    test = docs.join(labels.where("doc_id % 2 = 1"), "doc_id").select("doc_id", "text", "quality")
    rows = Q.judge(test, model).where("not base_failed").select("kept", "probability", "quality").collect()
    assert np.mean([r["kept"] == (r["quality"] == 1) for r in rows]) > 0.97
    assert abs(np.mean([r["probability"] for r in rows]) - np.mean([r["quality"] for r in rows])) < 0.15


def test_quality_edges(spark):
    df = spark.createDataFrame([(1, None, True), (None, "w " * 60, True), (3, " ".join(map(str, range(60))), True)], "doc_id long, text string, kept boolean")
    model = Q.fit(df, spark.createDataFrame([(3, None), (None, 1), (3, 1)], "doc_id long, quality int"))
    assert model is None
    out = {r["doc_id"]: r for r in Q.judge(df, model).collect()}
    assert (out[1]["kept"], out[None]["kept"], out[3]["kept"]) == (False, False, True)
    assert Q.judge(df.limit(0), None).count() == 0
