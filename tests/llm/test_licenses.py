import random
import time
from collections import Counter

from tessera.llm import licenses as C
from tessera.llm._shared import words


SHORT = [x for x in C.NOTICES if len(x[1].split()) < 45]


def brute(text, templates, t=C.THRESHOLD):
    """The same choice of passages with every run of every template counted out."""
    lines = [words(x) for x in (text or "").split("\n")]
    own = [x for w in lines for x in w]
    pairs, line = C.bigrams(own) if own else [], [i for i, w in enumerate(lines) for _ in w]
    runs = []
    for k, (_, template) in enumerate(templates):
        b = Counter(C.bigrams(words(template)))
        best = {}
        for i in range(len(pairs)):
            for j in range(i, len(pairs)):
                d = C.dice(Counter(pairs[i : j + 1]), b)
                if d > best.get(i, (0, 0))[0]:
                    best[i] = (d, j)
        i = 0
        while i < len(pairs):
            d, j = best.get(i, (0, 0))
            if d < t:
                i += 1
                continue
            at, look = i, i + 1
            while look <= j:
                if best.get(look, (0, 0))[0] > d:
                    at, (d, j) = look, best[look]
                look += 1
            runs.append((-d, at - j, at, k, j))
            i = j + 1
    found, taken = {}, set()
    for d, _, i, k, j in sorted(runs):
        if not taken & set(range(i, j + 1)):
            taken |= set(range(i, j + 1))
            found.setdefault(templates[k][0], (round(-d, 9), line[i], line[min(j + 1, len(line) - 1)]))
    return sorted(((n, *x) for n, x in found.items()), key=lambda x: (-x[1], x[0]))


def test_every_run_of_words():
    r, scanner = random.Random(1), C.Scanner(SHORT)
    several = 0
    for _ in range(80):
        parts = []
        for _ in range(r.randint(0, 3)):
            w = r.choice(SHORT)[1].split(" ")
            for _ in range(r.choice([0, 0, 1])):
                w[r.randrange(len(w))] = r.choice(["other", "license", "the"])
            parts += [[r.choice(["the", "license", "under", "licensed", "of", "a"]) for _ in range(r.randint(0, 6))], w]
        text = "".join(w + r.choice([" ", " ", "\n"]) for part in parts for w in part)
        got = [(n, round(d, 9), a, b) for n, d, a, b in scanner.find(text)]
        assert got == brute(text, SHORT), text
        several += len(got) > 1
    assert several > 5


def test_relatives_do_not_take_each_others_name():
    scanner = C.Scanner()
    for name, text in C.TEMPLATES:
        found = scanner.find("Before it.\n" + text + "\nAfter it.")
        assert found[0][:2] == (name, 1.0), (name, found)
    for name in ("GPL-2.0", "LGPL-2.1", "AGPL-3.0", "GPL-3.0"):
        notice = next(t for n, t in C.NOTICES if n == name and len(t) > 200)
        assert [n for n, *_ in scanner.find(notice.replace("This", "this"))] == [name]


def test_a_flood_of_template_words():
    """Many lines full of template words, and many blank lines: the work stays in proportion."""
    r, scanner = random.Random(4), C.Scanner()
    flood = [w for _, t in C.NOTICES for w in t.split()]
    text = "\n".join(" ".join(r.choice(flood) for _ in range(12)) + "\n" * 20 for _ in range(1500))
    began = time.perf_counter()
    scanner.find(text)
    one = time.perf_counter() - began
    assert [x[:2] for x in scanner.find("Released under the MIT License.\n" * 3000)] == [("MIT", 1.0)]
    began = time.perf_counter()
    scanner.find(text * 4)
    assert time.perf_counter() - began < 12 * one + 2


def test_exact_notice_in_a_document():
    text = "Some prose.\nLicensed under CC BY-NC 4.0.\nMore prose under the sun."
    assert C.Scanner().find(text)[0] == ("CC-BY-NC-4.0", 1.0, 1, 1)
    assert C.Scanner().find("licensed prose under no license at all, version two") == []


def test_odd(odd, none):
    out = C.scan(odd)
    assert out.count() == odd.count() and out.where("n_licenses <> 0 or licenses <> ''").count() == 0
    assert C.scan(none).count() == 0


def test_table(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in C.op10_licenses(spark, sf).collect():
        notices = {"Released under the MIT License.": "MIT", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0"}
        want = {n for line, n in notices.items() if line in (docs[r.doc_id] or "").split("\n")}
        assert set(filter(None, r.licenses.split(","))) == want


def test_notice_inside_a_line(spark):
    scanner = C.Scanner()
    assert scanner.find("Intro.\nThis file is part of Foo. Licensed under the Apache License, Version 2.0.")[0] == ("Apache-2.0", 1.0, 1, 1)
    name, d, a, b = scanner.find("The code is released under the MIT License.")[0]
    assert (name, d, a, b) == ("MIT", 1.0, 0, 0)
    one_line = "word " * 500 + " ".join(dict(C.NOTICES)["MIT"].split()) + " word" * 500
    assert scanner.find(one_line)[0][:2] == ("MIT", 1.0)
    out = C.scan(spark.createDataFrame([(1, "Foo is licensed under CC BY-NC 4.0. Enjoy.")], "doc_id long, text string")).first()
    assert (out.licenses, out.best_dice) == ("CC-BY-NC-4.0", 1.0)
