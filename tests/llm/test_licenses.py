"""Windows of the licence scan: notices wrapped over lines or beside other sentences, against brute force."""

import random
import textwrap
import time

import numpy as np

from tickloom.llm import licenses

from .conftest import SCHEMA, rows

T = licenses.THRESHOLD


def plain(text):
    return "".join(c.lower() if c.isascii() and c.isalnum() or not c.isascii() else " " for c in text).split()


def pairs(w):
    return list(zip(w, w[1:]))


def dice(a, b):
    return 2 * len(set(a) & set(b)) / (len(set(a)) + len(set(b))) if a or b else 0


def brute(text, templates, more):
    """{(license_id, dice, n_parts)} by all windows of all templates."""
    lines = [plain(x) for x in text.split("\n")]
    w, line = sum(lines, []), [k for k, x in enumerate(lines) for _ in x]
    wanted = {k: pairs(plain(t)) for k, t in {**templates, **more}.items()}
    parts, hits, at = [], [], 0
    units = []
    for x in lines:
        units.append((at, at + len(x)))
        at += len(x)
    for a, b in units + ([(0, len(w))] if len(lines) > 1 else []):
        d = {k: dice(pairs(w[a:b]), wanted[k]) for k in templates}
        top = max(d.values())
        if top >= T:
            for k in d:
                if d[k] == top:
                    parts.append((a, b, k, len(set(pairs(w[a:b])) & set(wanted[k]))))
                    hits.append((k, top))
    seen = []
    for k, want in wanted.items():
        size = len(set(want))

        def fits(r):
            return T / (2 - T) * size - 1e-9 <= len(set(pairs(lines[r]))) <= (2 - T) / T * size + 1e-9

        def search(lo, hi):
            best = None
            for i in range(lo, hi):
                for j in range(i + 2, min(hi, i + 1 + int((2 - T) / T * len(want) + 1e-9)) + 1):
                    if line[i] == line[j - 1] and j - i - 1 < len(want) and fits(line[i]):
                        continue
                    d = dice(pairs(w[i:j]), want)
                    if d >= T and (best is None or (-d, j - i, i) < best[0]):
                        best = ((-d, j - i, i), i, j)
            if best:
                _, i, j = best
                seen.append((-len(set(pairs(w[i:j])) & set(want)), best[0][0], i, j, k))
                search(lo, i)
                search(j, hi)

        closed = {x for a, b, name, _ in parts if name == k for x in range(a, b)}
        at = 0
        for x in [*sorted(closed), len(w)]:
            search(at, x)
            at = x + 1
    told = []
    for s, d, a, b, k in sorted(seen):
        if any(x < b and a < y and n >= -s for x, y, _, n in parts) or any(x < b and a < y and (s, d, a, b) != o for x, y, o in told):
            continue
        told.append((a, b, (s, d, a, b)))
        hits.append((k, -d))
    return {(k, round(max(d for n, d in hits if n == k), 9), sum(n == k for n, _ in hits)) for k in {n for n, _ in hits}}


def scanned(spark, texts, **given):
    got = {}
    for r in licenses.scan(spark.createDataFrame(rows(texts), SCHEMA), **given).collect():
        got.setdefault(r["doc_id"], set()).add((r["license_id"], round(r["dice"], 9), r["n_parts"]))
    return got


def filler(rng, n):
    return " ".join("".join(rng.choice(["an", "er", "th", "ou", "in"]) for _ in range(3)) for _ in range(n))


def test_wrapped_and_beside_sentences(spark):
    rng = random.Random(1)
    mit = "\n".join(textwrap.wrap(licenses.TEMPLATES["mit"], 78))
    whole = licenses.longer()["mit-text"]
    texts = [
        f"{filler(rng, 200)}\n{mit}\n{filler(rng, 200)}",
        f"{filler(rng, 40)}. Released under the MIT License. {filler(rng, 40)}",
        "\n".join(textwrap.wrap(f"{filler(rng, 300)} {whole} {filler(rng, 300)}", 60)),
        f"{filler(rng, 30)}\n{licenses.NOTICES['lgpl-3.0-line']}",
        filler(rng, 300),
    ]
    got = scanned(spark, texts)
    assert got[0] == {("mit", 1.0, 1)} and got[1] == {("mit-line", 1.0, 1)} and got[2] == {("mit-text", 1.0, 1)}
    assert ("lgpl-3.0-line", 1.0, 1) in got[3] and 4 not in got
    for name, t in licenses.longer().items():
        wrapped = "\n".join(textwrap.wrap(f"{filler(rng, 100)} {t} {filler(rng, 100)}", 70))
        assert (name, 1.0, 1) in scanned(spark, [wrapped])[0] if len(t) < 3000 else True


def test_against_all_windows(spark):
    rng = random.Random(4)
    templates = {k: licenses.TEMPLATES[k] for k in ("mit-line", "gpl-3.0-line", "gpl-2.0-line", "cc-by-4.0", "bsd")}
    more = {"twice": "the cat and the cat and the dog sat", "bsd-long": licenses.TEMPLATES["bsd"] + " redistributions of source code must retain the notice", "mit-too": "released under the mit license now"}
    texts = []
    for _ in range(60):
        bits = []
        for _ in range(rng.randint(1, 5)):
            w = rng.choice([*templates.values(), *more.values()]).split()
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                x = rng.randrange(len(w))
                w[x : x + rng.randint(0, 1)] = rng.choice([[], ["other"], ["the", "software"]])
            bits += [rng.choice(["", filler(rng, rng.randint(1, 6))]), " ".join(w[rng.choice([0, 0, 2]) :])]
        words = " ".join(bits).split()
        texts.append("".join(x + (rng.choice("  \n") if rng.random() < 0.3 else " ") for x in words))
    got = scanned(spark, texts, templates=templates, more=more)
    assert got == {i: b for i, t in enumerate(texts) if (b := brute(t, templates, more))}
    assert len(got) > 30


def test_recall_of_wrapped_commented_and_inline_notices(spark):
    """Every template in three customary forms inside other text: at least nine of ten are found by name."""
    rng = random.Random(12)
    every = {**licenses.TEMPLATES, **licenses.longer()}
    texts, wanted = [], []
    for name, t in every.items():
        one = " ".join(t.split())
        wrapped = textwrap.wrap(one, 72)
        texts += ["\n".join([filler(rng, 60), *wrapped, filler(rng, 60)]), "\n".join([f"# {x}" for x in wrapped]) + "\n\nimport os\n" + filler(rng, 80), f"{filler(rng, 80)}. {one} {filler(rng, 80)}"]
        wanted += [name] * 3
    got = scanned(spark, texts)
    found = [any(k == name for k, _, _ in got.get(i, ())) for i, name in enumerate(wanted)]
    assert sum(found) >= 0.9 * len(found), [(n, i % 3) for i, (n, ok) in enumerate(zip(wanted, found)) if not ok]


def test_null_ids_and_repeated_rows(spark):
    line = "Released under the MIT License."
    df = spark.createDataFrame([(None, line), (None, line), (1, line), (1, f"some other words\n{line}\n{line}"), (2, None)], "doc_id long, text string")
    got = {r["doc_id"]: (r["license_id"], r["n_parts"]) for r in licenses.scan(df).collect()}
    assert got == {None: ("mit-line", 2), 1: ("mit-line", 3)}


def test_very_many_notices_in_one_text():
    """Windows are swept in order: four times the notices take about four times as long, and each of them counts."""
    scanner = licenses.Scanner(licenses.TEMPLATES, licenses.THRESHOLD, licenses.longer())
    notice = licenses.TEMPLATES["mit-line"]

    def took(n):
        buf = np.frombuffer(" and so on it goes. ".join([notice] * n).encode(), np.uint8)
        began = time.process_time()
        found = list(scanner.scan(buf, np.array([0, len(buf)])))
        assert len(found) == n and {x[1] for x in found} == {"mit-line"}
        return time.process_time() - began

    took(500)
    assert took(12_000) < 10 * took(3_000) + 0.5
