import itertools
import random

import pytest

from millrace.llm import licenses as L
from millrace.llm import licenses_query


def test_increasing_like_brute_force():
    r = random.Random(3)
    for _ in range(100):
        ys = r.sample(range(20), r.randint(0, 9))
        got = L._increasing(list(enumerate(ys)))
        best = max((len(c) for k in range(len(ys) + 1) for c in itertools.combinations(ys, k) if list(c) == sorted(c)), default=0)
        assert len(got) == best and [y for _, y in got] == sorted(y for _, y in got)


def test_alignment_is_in_order_and_of_equal_words():
    r = random.Random(4)
    for _ in range(100):
        a, b = r.choices("abcdefg", k=r.randint(0, 20)), r.choices("abcdefg", k=r.randint(0, 20))
        pairs = L.align(a, b)
        assert all(a[i] == b[k] for i, k in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
        assert len(L.align(a, a)) == len(a)


@pytest.fixture(scope="module")
def scanner():
    return L.Scanner(L.standard_templates())


def test_every_template_is_found_whole_and_twice(scanner):
    whole = {t.license: t.text for t in L.standard_templates() if t.needed_from is None}
    assert {"MIT", "BSD-2-Clause", "BSD-3-Clause", "ISC", "Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0"} <= set(whole)
    for name, t in whole.items():
        text = f"Some words before. {t.upper()} and more in between, then {t} The end."
        got = [(f.license, f.coverage) for f in scanner.find(text) if f.matched > 20 or len(L.words_of(t)) < 60]
        assert got == [(name, 1.0)] * 2


def test_notices_name_their_license(scanner):
    for license, names in L.notices().items():
        for name in names:
            for text in (f"This project is licensed under the {name}.", f"Released under {name}, see the file.", f"All of it is available UNDER THE {name.upper()}"):
                got = scanner.find(f"Some words go before. {text} And some come after.")
                assert [(f.license, f.coverage) for f in got] == [(f"{license} (notice)", 1.0)], text
    for text in ("licensed under the Foo License", "licensed under the GNU license", "a license under version 3 of the MIT course", "the rights are reserved", "under the Apache License, Version 1.0", "under CC 4.0"):
        assert scanner.find(text) == [], text
    assert [f.license for f in scanner.find("Copyright 2020. All rights reserved. Licensed under the MIT License")] == ["All rights reserved (notice)", "MIT (notice)"]


def test_parts_of_a_license_are_not_the_license(scanner):
    for name in ("BSD-2-Clause", "ISC", "Unlicense"):
        words = L.words_of(L.TEXTS[name])
        assert scanner.find(" ".join(words[: len(words) * 2 // 3])) == []


def test_changed_texts_are_found_until_too_little_is_left(scanner):
    r = random.Random(5)
    words = L.words_of(L.TEXTS["MIT"])
    for drop, found in ((0.05, True), (0.12, True), (0.6, False)):
        for _ in range(10):
            text = " ".join(["lorem"] * 30 + [w for w in words if r.random() > drop] + ["ipsum"] * 30)
            assert bool([f for f in scanner.find(text) if f.license == "MIT"]) == found
    assert scanner.find("This is a plain text about a license to drive under the law, version 3 of it.") == []


def test_findings_like_brute_force(scanner):
    """Coverage is that of aligning the template with the whole of a text that has it once, in any window."""
    r = random.Random(9)
    for name in ("MIT", "ISC", "Apache-2.0 (header)"):
        words = L.words_of(L.TEXTS[name])
        for _ in range(5):
            kept = [w for w in words if r.random() > 0.08]
            (f,) = scanner.find(" ".join(["lorem"] * r.randint(0, 20) + kept + ["dolor"] * r.randint(0, 20)))
            # The longest common subsequence is what a whole alignment can match at most.
            row = [0] * (len(words) + 1)
            for x in kept:
                last = row[:]
                for k, y in enumerate(words):
                    row[k + 1] = last[k] + 1 if x == y else max(last[k + 1], row[k])
            assert f.license == name and 0.9 * row[-1] <= f.matched <= row[-1] == len(kept)


def test_many_findings_in_one_text(scanner):
    import time

    began = time.process_time()
    text = "Released under the MIT License. Some words. " * 20_000 + "of the license in the course of the work under the terms of the law " * 5_000
    assert len(scanner.find(text)) == 20_000
    assert time.process_time() - began < 60


def test_documents(spark, docs, odd, tmp_path):
    rows = [*odd, (20, "Text.\nReleased under the MIT License."), (20, "Text.\nReleased under the MIT License."), (21, "x " * 100_000 + L.TEXTS["ISC"])]
    out = sorted(tuple(r)[:3] for r in L.scan(docs(rows)).collect())
    assert out == [(20, "MIT (notice)", 1.0)] * 2 + [(21, "ISC", 1.0)]
    assert L.scan(docs([])).count() == 0
    docs(rows).write.parquet(str(tmp_path / "documents.parquet"))
    assert licenses_query.op9_license_scan(spark, str(tmp_path)).count() == 3
