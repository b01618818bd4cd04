"""Operators 1, 2, 3, 6, 7: whole texts against brute force."""
import hashlib
import random
import re
import textwrap
import time
from collections import Counter

import pytest

from reqlens.llm import op1_decontamination as dec
from reqlens.llm import op2_license_scan as lic
from reqlens.llm import op3_token_counts as cnt
from reqlens.llm import op6_pii as pii
from reqlens.llm import op7_quality_rules as rules
from reqlens.llm.common import read_table

tokenizers = pytest.importorskip("public_tokenizers")
PATH, PATTERN = tokenizers.path("byte_bpe_50k.json"), tokenizers.PATTERN


@pytest.fixture(scope="module")
def docs(spark, sf):
    return read_table(spark, sf, "documents")


# ------------------------------------------------------------------------ 1
def test_decontamination_recall_under_edits(spark, sf):
    """Planted items with random word edits are found at the target recall."""
    rnd = random.Random(1)
    items = [(r["item_id"], r["text"]) for r in read_table(spark, sf, "benchmark").collect()]
    index = dec.Index(items)
    vocab = [w for _, t in items for w in dec.words_of(t)]
    for rate, least in ((0.0, 1.0), (0.1, 0.97)):
        hit = 0
        for item, text in items:
            w = dec.words_of(text)
            for _ in range(int(len(w) * rate)):
                k = rnd.randrange(len(w))
                w[k:k + 1] = rnd.choice(([], [rnd.choice(vocab)], [w[k], rnd.choice(vocab)]))
            doc = [rnd.choice(vocab) for _ in range(40)] + w + [rnd.choice(vocab) for _ in range(40)]
            hit += item in {h[0] for h in index.search([dec.hashed(doc)])[0]}
        assert hit >= least * len(items)


def test_decontamination_finds_every_short_item_at_its_edit_limit():
    rnd = random.Random(21)
    items = [(i, " ".join(f"w{rnd.randrange(3000)}" for _ in range(7 + i % 24))) for i in range(960)]
    index = dec.Index(items)
    for item, text in items:
        for edits in (0, dec.max_edits(len(text.split()))):
            w = dec.words_of(text)
            for k in sorted(rnd.sample(range(len(w)), edits), reverse=True):
                w[k:k + 1] = rnd.choice(([], [b"new"], [w[k], b"new"]))
            doc = [b"before"] * 30 + w + [b"after"] * 30
            assert item in {h[0] for h in index.search([dec.hashed(doc)])[0]}


def test_decontamination_finds_verbatim_items_only(spark, sf, docs):
    got = {(r["doc_id"], r["item_id"]) for r in dec.query(spark, sf).where("edits = 0").collect()}
    items = [(r["item_id"], " ".join(w.decode() for w in dec.words_of(r["text"]))) for r in read_table(spark, sf, "benchmark").collect()]
    want = set()
    for r in docs.collect():
        own = " " + " ".join(w.decode() for w in dec.words_of(r["text"])) + " "
        want |= {(r["doc_id"], i) for i, t in items if f" {t} " in own}
    assert got == want


def test_nearest_is_the_least_edit_distance():
    rnd = random.Random(2)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]
    for _ in range(200):
        a, b = ([rnd.randrange(4) for _ in range(rnd.randrange(1, 7))] for _ in range(2))
        best = min(distance(a, b[i:j]) for i in range(len(b) + 1) for j in range(i, len(b) + 1))
        edits, s, e = dec.nearest(a, b, 99)
        assert edits == best == distance(a, b[s:e])


def test_decontamination_odd_rows(odd, none, benchmark):
    rows = {(r["doc_id"], r["item_id"], r["edits"]) for r in dec.contamination(odd, benchmark).collect()}
    assert rows == {(1, 1, 0), (1, 4, 0), (2, 1, 0), (2, 4, 0), (6, 2, 0)}
    clean = dec.drop_contaminated(odd, benchmark)
    assert clean.columns == odd.columns and {r["doc_id"] for r in clean.collect()} == {3, 4, 5, None, 8, 9, 10}
    assert dec.contamination(none, benchmark).count() == 0
    assert dec.contamination(odd, benchmark.limit(0)).count() == 0
    assert dec.drop_contaminated(odd, benchmark.limit(0)).count() == odd.count()


# ------------------------------------------------------------------------ 2
@pytest.mark.parametrize("text, license", [
    ("This work is licensed under the GNU General Public License, version 3.", "GPL-3.0"),
    ("This work is licensed under the GNU General Public License, version 2.", "GPL-2.0"),
    ("Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"), ("Licensed under CC BY 4.0.", "CC-BY-4.0"),
    ("Licenced under the Apache License, Version 2.0.", "Apache-2.0"), ("Released under the MIT License.", "MIT"),
    ("Licensed under the Apache License, Version 1.1.", None), ("He got a fishing license last year.", None)])
def test_license_of_a_line(text, license):
    body = f"Some prose first.\n{text}\nAnd prose after."
    (a, b), = lic.blocks(body)
    assert body[a:b] == text and lic.judge(text)[0] == license


def test_every_license_of_a_block_is_reported():
    text = "Licensed under the MIT license.\nLicensed under the Apache License, Version 2.0.\nReleased under CC0 1.0 Universal."
    (a, b), = lic.blocks(text)
    assert sorted(x[0] for x in lic.judge_all(text[a:b])) == ["Apache-2.0", "CC0-1.0", "MIT"]
    long = "x " * 2000 + "license " + "y " * 185 + "Licensed under the Apache License, Version 2.0. " + "z " * 2000
    assert any(x[0] == "Apache-2.0" for a, b in lic.blocks(long) for x in lic.judge_all(long[a:b]))


def wrapped(text, mark=""):
    return "\n".join(mark + x for x in textwrap.wrap(text, 72))


@pytest.mark.parametrize("name", ["Apache-2.0", "MIT", "MIT-0", "BSD-2-Clause", "BSD-3-Clause", "GPL-3.0", "LGPL-2.1", "CC-BY-SA-4.0"])
def test_license_of_an_spdx_tag(name):
    assert [x[2] for x in lic.findings(f"// SPDX-License-Identifier: {name}\nint x;")] == [name]


def test_license_texts_that_share_their_beginning():
    good = " The Software shall be used for Good, not Evil."
    bsd = lic._REDISTRIBUTION + lic._CONDITIONS
    for name, text in [("MIT", lic._GRANT + lic._NOTICE), ("MIT-0", lic._GRANT + "."), ("JSON", lic._GRANT + lic._NOTICE + good),
                       ("BSD-2-Clause", bsd), ("BSD-3-Clause", bsd + lic._ENDORSEMENT), ("0BSD", lic._PERMISSION + "."),
                       ("ISC", lic._PERMISSION + lic._APPEAR)]:
        for body in (text, wrapped(text), wrapped(text, "# "), "Some prose.\n" + wrapped(text) + "\n\nMore prose."):
            assert [x[2] for x in lic.findings(body) if x[-1]] == [name], (name, body)


def test_a_license_of_several_paragraphs_is_reported_once():
    first, rest = lic._NOTICE.split(": ", 1)
    text = ("Copyright (c) 2020 Someone\n\n" + wrapped(lic._GRANT + first + ":") + "\n\n" + wrapped(rest) + "\n\n"
            + wrapped('THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED.'))
    got = [x for x in lic.findings(text) if x[-1]]
    assert [x[2] for x in got] == ["MIT"] and text[got[0][0]:got[0][1]].startswith("Permission is hereby granted")


def test_a_long_list_of_notices_takes_linear_time():
    text = "\n".join(f"part {i}: Licensed under the {'MIT license' if i % 2 else 'Apache License, Version 2.0'}." for i in range(3000))
    start = time.process_time()
    got = Counter(x[2] for x in lic.findings(text))
    assert got == {"MIT": 1500, "Apache-2.0": 1500} and time.process_time() - start < 30


def test_license_scan_finds_every_planted_line(spark, sf, docs):
    got = Counter((r["doc_id"], r["license"]) for r in lic.query(spark, sf).where("confirmed").collect())
    plant = {"Released under the MIT License.": "MIT", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
             "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
             "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0"}
    for r in docs.collect():
        for line in (r["text"] or "").split("\n"):
            if line in plant:
                assert got[r["doc_id"], plant[line]] >= 1


def test_license_odd_rows(odd, none):
    rows = lic.license_blocks(odd).collect()
    assert [(r["doc_id"], r["license"], r["confirmed"]) for r in rows] == [(10, "MIT", True)]
    assert lic.license_blocks(none).count() == 0


# ------------------------------------------------------------------------ 3
def test_counts_after_edits_equal_full_encoding(docs):
    c, rnd = cnt.Counter.of(PATH, PATTERN), random.Random(3)
    bits = ["", " ", "  ", "\n\n", "x", "'s", "don", "12", "3.", "é", " word", "   ", "!!", "<EMAIL>"]
    for text in [r["text"] for r in docs.limit(60).collect()] + ["", "  ", " " * 300 + "a", "x" * 300, "\n  \n x" * 40]:
        chars, tokens = c.leaves(text)
        for _ in range(3):
            edits, at = [], 0
            for _ in range(rnd.randrange(1, 4)):
                if at > len(text):
                    break
                s = rnd.randrange(at, len(text) + 1)
                e = min(len(text), s + rnd.choice([0, 0, 1, 2, 40, 600]))
                edits.append((s, e, "".join(rnd.choice(bits) for _ in range(rnd.randrange(4)))))
                at = e + 1
            want, at = "", 0
            for s, e, r in edits:
                want, at = want + text[at:s] + r, e
            want += text[at:]
            text, chars, tokens, n, _ = cnt.apply_edits(c, text, chars, tokens, edits)
            assert text == want and chars.sum() == len(text)
            assert n == tokens.sum() == len(c.tok.encode(text, add_special_tokens=False).ids)


def test_only_regions_are_encoded_again():
    c = cnt.Counter.of(PATH, PATTERN)
    text = "some words of a long text " * 4000
    _, _, _, _, again = cnt.apply_edits(c, text, *c.leaves(text), [(50_000, 50_004, "edit")])
    assert again < 3000


def test_counts_odd_rows(odd, none):
    c = cnt.Counter.of(PATH, PATTERN)
    trees = cnt.build_trees(odd, PATH, PATTERN)
    done = cnt.recount(cnt.with_cleaning_edits(trees.drop("edits")), PATH, PATTERN)
    for r in done.collect():
        assert r["n_tokens"] == len(c.tok.encode(r["text"] or "", add_special_tokens=False).ids)
    assert cnt.recount(cnt.with_cleaning_edits(cnt.build_trees(none.drop("edits"), PATH, PATTERN)), PATH, PATTERN).count() == 0


# ------------------------------------------------------------------------ 6
BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_spans(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")) \
                    or kind == "card" and not (16 <= len(d) <= 19 and pii.luhn(d)) or kind == "phone" and not 8 <= len(d) <= 15:
                continue
            out.append((kind, *m.span()))
    return out


def test_base_spans_equal_plain_patterns():
    rnd = random.Random(4)
    for _ in range(20_000):
        t = "".join(rnd.choice("a1.2@+- 3(5)9..@-é") for _ in range(rnd.randrange(40)))
        assert pii.base_spans(t) == brute_spans(t)


def test_long_runs_are_linear():
    for t in ("a" * 200_000, "1" * 200_000, "a@" * 50_000, "+1 " + "(" * 100_000, "1." * 50_000):
        pii.candidates(t, pii.base_spans(t))


def test_a_token_of_any_length_is_a_candidate():
    for n in (24, 128, 160, 5000):
        text = "api_key = " + "aB3" * n
        assert any(c[:3] == ("secret", 10, len(text)) for c in pii.candidates(text, []))


def test_personal_data_query(spark, sf, docs):
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in pii.query(spark, sf).collect():
        base = brute_spans(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(pii.joined(base).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == k for s in base) for k in pii.KINDS]
        assert {f"{k}:{a}:{b}" for k, a, b in base} <= set(r["spans"].split(","))


def test_reliabilities_are_recovered():
    """Three labelers of known quality on simulated spans."""
    import numpy as np
    rng = np.random.default_rng(5)
    truth = rng.random(20_000) < 0.4
    votes = np.stack([np.where(rng.random(20_000) < a, truth, ~truth) for a in (0.9, 0.8, 0.7)], axis=1).astype(int)
    patterns, count = np.unique(votes, axis=0, return_counts=True)
    p, true, false = pii.estimate(patterns, count.astype(float))
    assert np.allclose(true, (0.9, 0.8, 0.7), atol=0.05) and np.allclose(false, (0.1, 0.2, 0.3), atol=0.05)


def test_personal_data_odd_rows(odd, none):
    empty = hashlib.sha256(b"").hexdigest()
    rows = pii.personal_data(odd).collect()
    assert len(rows) == odd.count()
    by = {r["doc_id"]: r for r in rows}
    assert by[3]["base_sha256"] == by[4]["base_sha256"] == empty and by[4]["spans"] == ""
    assert (by[None]["n_email"], by[None]["n_phone"], by[9]["n_ip"], by[9]["n_card"]) == (1, 1, 1, 1)
    assert pii.personal_data(none).count() == 0


# ------------------------------------------------------------------------ 7
def brute_metrics(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, cover = Counter(zip(w, w[1:], w[2:])), set()
    for i in range(len(w) - 2):
        if seen[tuple(w[i:i + 3])] > 1:
            cover |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(cover),
            len(w) < 50 or 100 * len(cover) > 50 * len(w))


METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def test_quality_metrics_equal_brute_force(spark, sf, docs, odd, monkeypatch):
    for few in (rules.FEW, 0):            # both ways to find repeats
        monkeypatch.setattr(rules, "FEW", few)
        for table in (docs, odd):
            for r in rules.document_metrics(table.select("doc_id", "text")).collect():
                assert tuple(r[m] for m in METRICS) == brute_metrics(r["text"])


def test_quality_rules_run_without_python(spark, sf):
    plan = rules.query(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_quality_rules_keep_clean_documents(spark):
    sf = "/root/testdata/sf0.01"
    got = rules.query(spark, sf).join(read_table(spark, sf, "labels"), "doc_id").where("not base_failed").collect()
    good = [r["kept"] for r in got if r["quality"] == 1]
    bad = [r["kept"] for r in got if r["quality"] == 0]
    assert sum(good) >= 0.99 * len(good) and sum(bad) <= 0.1 * len(bad)


def test_quality_fences_follow_their_group(spark):
    """Two sources of one language: in "b" a fifth of the lines repeats as a
    rule, in "a" none does, so only "a" loses a document for it."""
    rnd = random.Random(9)

    def text(repeats):
        lines = [" ".join(f"w{rnd.randrange(10**6)}" for _ in range(8)) for _ in range(20 - repeats)]
        return "\n".join(lines + lines[:1] * repeats)
    rows = [(i, text(0), "en", "a") for i in range(300)] + [(1000 + i, text(rnd.randrange(9)), "en", "b") for i in range(300)]
    rows += [(2000, text(7), "en", "a"), (2001, text(7), "en", "b")]
    m = rules.document_metrics(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    hi = {r["source"]: r["hi_dup_line_ratio"] for r in rules.adaptive_fences(m).collect()}
    assert hi["a"] == 0 and hi["b"] > 0.5
    kept = {r["doc_id"]: r["kept"] for r in rules.apply_fences(m, rules.adaptive_fences(m)).collect()}
    assert not kept[2000] and kept[2001] and all(kept[i] for i in range(300))


def test_quality_rules_odd_rows(odd, none):
    kept = rules.filter_quality(odd)
    assert kept.columns == odd.columns and kept.count() == 0
    assert rules.filter_quality(none).count() == 0


def test_token_counter_keeps_to_its_task_s_core():
    """The tokenizers library starts no threads of its own in a task, unless the session asks for them."""
    import os
    import subprocess
    import sys
    code = ("import os, public_tokenizers as p; from reqlens.llm.op3_token_counts import Counter; "
            "c = Counter.of(p.path('byte_bpe_50k.json'), p.PATTERN); c.leaves('some words are here ' * 500); "
            "print(os.environ['TOKENIZERS_PARALLELISM'])")
    env = {k: v for k, v in os.environ.items() if k != "TOKENIZERS_PARALLELISM"}
    env |= {"PYTHONPATH": os.pathsep.join(sys.path)}
    out = subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, text=True, check=True).stdout
    assert out.strip() == "false"
