import random

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from chatlake.llm import license_scan as L
from tests.conftest import SF

INDEX = L.LicenseIndex(L.TEMPLATES)


def brute(text, names=None):
    """Every template (or those named) against the whole text, without index or band."""
    ids = L.np.array([INDEX.ids.get(w, 0) for w in L.words(text)], L.np.int64)
    out = set()
    for name, template in zip(INDEX.names, INDEX.coded, strict=True):
        if names and name not in names:
            continue
        matched, _, _ = L.align(template, ids, -len(template), len(ids))
        if matched >= L.COVERAGE * len(template):
            out.add((name, matched))
    return out


def best(found):
    top = {}
    for name, _, matched, _, _ in found:
        top[name] = max(top.get(name, 0), matched)
    return set(top.items())


def test_documents_against_brute_force(spark):
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()}
    rows = L.op4_license_scan(spark, SF).collect()
    assert rows
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append((r.license, r.coverage, r.matched_words, r.first_word, r.end_word))
    for i, t in texts.items():
        assert by_doc.get(i, []) == INDEX.scan(t), i
        if len(t) < 6000:
            assert best(INDEX.places(L.words(t))) == brute(t), i


def test_edited_templates_are_found():
    rnd = random.Random(3)
    for name, text in L.TEMPLATES.items():
        w = text.split()
        if len(w) < 20:
            continue
        for _ in range(5):
            edited = list(w)
            for _ in range(len(w) // 20):
                edited[rnd.randrange(len(edited))] = "changed"
                edited.insert(rnd.randrange(len(edited)), "added")
            found = [r for r in INDEX.places(L.words(" ".join(["lead"] * 7 + edited + ["tail"] * 5).encode())) if r[0] == name]
            assert found and found[0][1] >= 0.8 and 5 <= found[0][3] <= 12


def test_places():
    found = INDEX.scan(b"x all rights reserved. ALL  rights\nreserved! y released under the mit license")
    assert [(r[0], r[3], r[4]) for r in found] == [("all-rights-reserved", 1, 4), ("all-rights-reserved", 4, 7), ("mit-notice", 8, 13)]


def test_alignment_against_plain_table():
    """Scores by the plain recurrence, over small alphabets."""
    rnd = random.Random(4)
    for _ in range(300):
        t, x = ([rnd.randrange(1, 4) for _ in range(rnd.randint(1, n))] for n in (7, 12))
        top = {(-1, i): (0, 0, 0) for i in range(-1, len(x))} | {(j, -1): (0, 0, 0) for j in range(len(t))}
        best = (0, 0, 0)
        for j in range(len(t)):
            for i in range(len(x)):
                s, m, b = top[j - 1, i - 1]
                ways = [(s + 1, m + 1, b if s else -i) if t[j] == x[i] else (s - 1, m, b), (top[j - 1, i][0] - 1, *top[j - 1, i][1:]), (top[j, i - 1][0] - 1, *top[j, i - 1][1:])]
                top[j, i] = max(max(ways), (0, 0, 0)) if max(ways)[0] > 0 else (0, 0, 0)
                best = max(best, top[j, i])
        matched, start, _ = L.align(L.np.array(t), L.np.array(x), -len(t), len(x))
        assert (matched, start) == (best[1], -best[2])


def test_repeated_notices_take_linear_time():
    import time

    times = []
    for n in (8_000, 33_000):
        text = ("All rights reserved. " * n).encode()
        began = time.process_time()
        found = INDEX.scan(text)
        times.append(time.process_time() - began)
        assert [(r[0], r[3], r[4]) for r in found] == [("all-rights-reserved", 3 * i, 3 * i + 3) for i in range(n)]
    assert times[1] < 60 and times[1] < 8 * times[0] + 1
    mixed = ("the software is provided " * 25_000).encode()
    began = time.process_time()
    assert not INDEX.scan(mixed)
    assert time.process_time() - began < 120


def named(text):
    return [r[0] for r in INDEX.scan(text.encode())]


def test_licences_aren_t_taken_for_their_neighbours():
    cases = {
        "This work is licensed under the GNU Lesser General Public License, version 2.1.": ["lgpl-2.1-notice"], "This work is licensed under the GNU General Public License, version 2.": ["gpl-2.0-notice"],
        "This work is licensed under the GNU General Public License, version 3.": ["gpl-3.0-notice"], "This work is licensed under the GNU Affero General Public License, version 3.": ["agpl-3.0-notice"],
        "Licensed under CC BY-NC-ND 4.0.": ["cc-by-nc-nd-4.0-notice"], "licensed under cc by sa 4.0": ["cc-by-sa-4.0-notice"], "Licensed under CC BY-ND 4.0": ["cc-by-nd-4.0-notice"], "Licensed under CC BY 4.0": ["cc-by-4.0-notice"],
        "Licensed under CC BY-NC 4.0.": ["cc-by-nc-4.0-notice"], "CC BY-NC-ND 4.0": [], "cc by sa 4.0": [], "Released under the GPL License.": [], "released under the mit license": ["mit-notice"],
        "This is not released under the MIT License.": [], "It isn't released under the MIT License.": [], "never was this released under the MIT license": [], "not released under the GPL License": [], "Not all rights reserved.": [],
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.": ["cc-by-sa"], "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.": [],
        "This work is licensed under a Creative Commons Attribution 4.0 International License.": ["cc-by"], "This work is licensed under a Creative Commons Attribution 3.0 Unported License.": [],
    }
    for text, want in cases.items():
        assert named(text) == want, text
    for name in ("lgpl-2.1-header", "lgpl-3.0-header", "agpl-3.0-header", "gpl-2.0-header", "mpl-2.0-header", "bsd-3-clause", "bsd-2-clause"):
        found = named(L.TEMPLATES[name])
        assert name in found and not {"gpl", "gpl-3.0-header", "bsd-2-clause", "bsd-3-clause"} & set(found) - {name}, (name, found)
    both = named(L.TEMPLATES["bsd-3-clause"] + " between " * 9 + L.TEMPLATES["bsd-2-clause"])
    assert [x for x in both if x != "bsd"] == ["bsd-3-clause", "bsd-2-clause"]


def test_edges(spark):
    df = spark.createDataFrame([(1, None), (1, ""), (None, "All rights reserved."), (2, "a " * 50_000)], "doc_id long, text string").withColumn("license", F.lit("clash"))
    assert [(r.doc_id, r.license) for r in L.scan_licenses(df).collect()] == [(None, "all-rights-reserved")]
    assert L.scan_licenses(df.limit(0)).count() == 0


def test_edits_against_unindexed_alignment():
    for name, template in L.TEMPLATES.items():
        w = [x.decode() for x in L.words(template.encode())]
        edits = [[*w[:i], "changed", *w[i + 1 :]] for i in range(len(w))] + [[*w[:i], *w[i + 1 :]] for i in range(len(w))] + [[*w[:i], "added", *w[i:]] for i in range(1, len(w))]
        if len(w) > 20:
            # a sentence in the middle, and a word after every two
            edits += [[*w[: len(w) // 2], *["more"] * (len(w) // 3), *w[len(w) // 2 :]], [x for i in range(0, len(w), 2) for x in (*w[i : i + 2], "x")]]
        # every edit of short templates, some of long ones, against the template itself and its neighbours
        for edited in edits if len(w) < 20 else random.Random(name).sample(edits, 25):
            text = " ".join(["lead"] * 7 + edited + ["tail"] * 5)
            near = {name, "mit-notice", "bsd", "gpl", "apache-2.0-notice"}
            assert {x for x in best(INDEX.places(L.words(text.encode()))) if x[0] in near} == brute(text.encode(), near), (name, text)
    assert INDEX.scan(b"Licensed under the Apache Licence, Version 2.0.")[0][:3] == ("apache-2.0-notice", 7 / 8, 7)
    assert [r[:3] for r in L.LicenseIndex({"one": "Unlicense"}).scan(b"the Unlicense.")] == [("one", 1.0, 1)]
