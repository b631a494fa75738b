import random
import re

from assayer.llm import licenses


def brute(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(licenses.WORD, low)
    at = [(i, label) for p, label in licenses.BASE.items() for n in [len(p.split())] for i in range(len(w) - n + 1) if w[i : i + n] == p.split()]
    starts = sorted(i for i, _ in at)
    return len(w), len(at), starts[0] if at else None, starts[-1] if at else None, ",".join(sorted({x for _, x in at}))


NAMED = {
    "Released under the MIT License.": "mit",
    "Licensed under the Apache License, Version 2.0.": "apache,apache-2.0",
    "This work is licensed under the GNU General Public License, version 3.": "gpl,gpl-3.0",
    "Licensed under CC BY-NC 4.0.": "cc-by-nc-4.0",
    "under the GNU Lesser General Public License v2.1 here": "gpl,lgpl-2.1",
    "SPDX-License-Identifier: BSD-3-Clause": "bsd-3-clause",
    "licence: GPL-2.0-or-later; see https://www.gnu.org/licenses/gpl-3.0": "gpl-2.0-or-later,gpl-3.0",
    "the license to drive was permitted": "",
    "Creative Commons Attribution-ShareAlike 3.0 Unported License": "cc-by-sa-3.0",
}


def test_all(spark):
    rnd = random.Random(4)
    bits = ["mit", "MIT License", "license", "Apache", "apache LICENSE", "general public license", "\n", "é", "x9", "--", ", ", "mit  license mit license"]
    rows = [(i, " ".join(rnd.choice(bits) for _ in range(rnd.randrange(14)))) for i in range(200)]
    rows += [(500, None), (501, ""), (502, "x" * 5000 + " mit license"), (503, "mit-license; amit license mit licenses"), (503, "mit license")]
    rows += [(1000 + i, t) for i, t in enumerate(NAMED)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, labels int")
    got = licenses.scan(df).collect()
    want = sorted([(d, *brute(t)) for d, t in rows], key=str)
    assert sorted([(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got], key=str) == want
    by = {r.doc_id: r for r in got}
    assert {t: by[1000 + i].labels for i, t in enumerate(NAMED)} == NAMED
    assert by[1005].score == 1.0 and by[1000].score == 0.9 and by[1007].score == 0.0
    for r in got:
        spans = [(x.start, x.end) for x in r.detections or []]
        assert not r.base_labels or set(r.base_labels.split(",")) <= set(r.labels.split(","))
        assert len(set(spans)) == len(spans)
    assert licenses.scan(df.limit(0)).count() == 0


def test_rules_compile():
    assert len(licenses.rules()) > 300
    for _, _, _, p in licenses.rules():
        re.compile(p)


def expand(pattern):
    """The shortest text of each alternative of an expression; where more than 50, the first ones of each part."""
    from itertools import islice, product

    def one(item):
        kind, v = str(item[0]), item[1]
        if kind == "LITERAL":
            return [chr(v)]
        if kind == "IN":
            return [chr(v[0][1]) if str(v[0][0]) == "LITERAL" else chr(v[0][1][0]) if str(v[0][0]) == "RANGE" else "a"]
        if kind == "BRANCH":
            return [t for p in v[1] for t in many(p)]
        if kind == "SUBPATTERN":
            return many(v[3])
        if kind == "MAX_REPEAT":
            return [t * v[0] for t in many(v[2])] if v[0] else [""]
        return [""]

    def many(items):
        return list(dict.fromkeys("".join(x) for x in islice(product(*map(one, items)), 50)))

    return many(licenses._parser.parse(pattern))


UNGATED = {
    "(c) 2020 Acme. All rights reserved.": "all-rights-reserved",
    "released under MPL 2.0": "mpl-2.0",
    "available under Apache-2.0": "apache-2.0",
    "distributed under the 3-clause BSD": "bsd-3-clause",
    "released under the WTFPL": "wtfpl",
    "https://www.mozilla.org/MPL/2.0/": "mpl-2.0",
    "https://creativecommons.org/publicdomain/zero/1.0/": "cc0-1.0",
    "It is in the public\ndomain.": "public-domain",
    "Creative\n  Commons BY 4.0": "cc-by-4.0",
}


def test_gate_is_no_narrower_than_the_rules(spark):
    gate = licenses.gate()
    for _, _, _, p in licenses.rules():
        for t in expand(p):
            assert re.search(p, t) and any(g in t for g in gate), (p, t)
    df = spark.createDataFrame(list(enumerate(UNGATED)), "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan(df).collect()}
    assert {t: got[i].labels for i, t in enumerate(UNGATED)} == UNGATED
    assert all(r.score > 0 for r in got.values())


SHORT = {
    "License: EPL-2.0": "epl-2.0", "License: OFL-1.1": "ofl-1.1", "License: BSL-1.0": "bsl-1.0", "License: CDDL-1.0": "cddl-1.0", "License: EUPL-1.2": "eupl-1.2",
    "License: ODbL-1.0": "odbl-1.0", "License: GFDL-1.3": "gfdl", "License: MPL": "mpl", "License: PSF-2.0": "python-2.0", "License: GPL-2.0+": "gpl-2.0-or-later",
    "the expat license": "mit", "the psf license": "python-2.0", "Creative\n  Commons Zero": "cc0-1.0",
}


def test_each_alternative_has_a_keyword(spark):
    roots = [(rule, r) for r, of in licenses.groups() for rule in of]
    assert sorted(x[3] for x, _ in roots) == sorted(x[3] for x in licenses.rules())
    minimal = []
    for (label, keywords, c, p), r in roots:
        for t in expand(p):
            assert re.search(p, t) and any(k in t for k in keywords) and any(k in t for k in r), (p, t)
            minimal.append((label, c, t))
    texts = list(SHORT) + [t for _, _, t in minimal]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    got = {r.doc_id: r for r in licenses.scan(df).collect()}
    for i, t in enumerate(SHORT):
        assert SHORT[t] in got[i].labels.split(",") and got[i].score == (0.6 if ":" not in t else 0.9), t
    for i, (label, c, t) in enumerate(minimal, len(SHORT)):
        assert got[i].score >= licenses.WEIGHT[c], t
        # A longer or better detection may hold this one.
        assert label in got[i].labels.split(",") or any(x["class"] <= c and x.label != label and x.end - x.start >= 3 for x in got[i].detections), (label, t, got[i].labels)
