import random

from cairn.llm import licenses as li


def whole_alignment(template, words):
    """Brute force: the best local alignment without a band, as (score, alike)."""
    best = (0, 0)
    before = [(0, 0)] * (len(words) + 1)
    for w in template:
        row = [(0, 0)]
        for j, x in enumerate(words):
            s, a = before[j]
            cell = (s + 2, a + 1) if w == x else (s - 1, a)
            cell = max(cell, (before[j + 1][0] - 1, before[j + 1][1]), (row[j][0] - 1, row[j][1]), key=lambda c: c[0])
            cell = cell if cell[0] > 0 else (0, 0)
            best = max(best, cell, key=lambda c: c[0])
            row.append(cell)
        before = row
    return best


def test_edited_templates_are_found_with_their_spans():
    rnd = random.Random(1)
    scanner = li.Scanner(li.TEMPLATES, 0.8)
    filler = [f"w{i}" for i in range(200)]
    for name, text in li.TEMPLATES.items():
        words = text.split()
        for _ in range(8):
            edited = list(words)
            for _ in range(len(words) // 20):
                i = rnd.randrange(len(edited))
                edited[i : i + 1] = rnd.choice([[], ["changed"], [edited[i], "added"]])
            before, after = (" ".join(rnd.choice(filler) for _ in range(rnd.randrange(60))) for _ in range(2))
            doc = f"{before}\n{' '.join(edited)}\n{after}"
            found = {m[0]: m for m in scanner.scan(doc)}
            want = whole_alignment(li.words_of(text), li.words_of(doc))[1] / len(li.words_of(text))
            if want >= 0.8:
                assert name in found and abs(found[name][1] - want) < 0.02, (name, want)
                a, b = found[name][3], found[name][4]
                assert len(before) < a < b <= len(doc) - len(after)


def test_templates_with_a_long_insertion_or_deletion_are_found():
    rnd = random.Random(2)
    scanner = li.Scanner(li.TEMPLATES, 0.8)
    for name in ("MIT", "ISC", "Apache-2.0-header", "GPL-3.0-header"):
        words = li.TEMPLATES[name].split()
        for count in (9, 14, 30):
            middle = len(words) // 2 + rnd.randrange(-8, 8)
            added = [*words[:middle], *(f"w{rnd.randrange(99)}" for _ in range(count)), *words[middle:]]
            for edited in (added, words[:middle] + words[middle + min(count, 12) :], [*added, *["x"] * 40, *added]):
                doc = f"before {' '.join(edited)} after"
                found = [m for m in scanner.scan(doc) if m[0] == name]
                want = whole_alignment(li.words_of(li.TEMPLATES[name]), li.words_of(doc))[1] / len(li.words_of(li.TEMPLATES[name]))
                if want >= 0.8:
                    assert len(found) == (2 if "x" in edited else 1), (name, count, want)
                    assert abs(found[0][1] - want) < 0.03 and found[0][3] == 7


def test_rows(spark):
    mit, apache = li.TEMPLATES["MIT-notice"], li.TEMPLATES["Apache-2.0-notice"]
    rows = [(1, f"é😀 {mit} x {mit}"), (2, None), (3, ""), (4, "No notice here."), (5, "word " * 50_000 + apache), (1, f"é😀 {mit} x {mit}")]
    df = spark.createDataFrame([(a, b, 0) for a, b in rows], "doc_id long, text string, license int")
    out = sorted(tuple(r) for r in li.scan(df).collect())
    first, second = 3, 3 + len(mit) + 3
    of_one = [(1, "MIT-notice", 1.0, 5, at, at + len(mit) - 1) for at in (first, second)]
    assert out == sorted(of_one * 2 + [(5, "Apache-2.0-notice", 1.0, 7, 250_000, 250_000 + len(apache) - 1)])
    text = rows[0][1]
    assert {text[r[4] : r[5]] for r in out if r[0] == 1} == {mit[:-1]}
    assert li.scan(df.limit(0)).count() == 0
    assert {r.license for r in li.scan(df, {"own": "no notice here"}).collect()} == {"own"}
    other = spark.createDataFrame([(1, "Licensed under CC BY-NC 4.0.")], "doc_id long, text string")
    assert [r.license for r in li.scan(other).collect()] == ["CC-BY-NC-4.0-notice"]


def test_many_notices_in_one_text_stay_linear():
    import time

    scanner, took = li.Scanner(li.TEMPLATES, 0.8), []
    for n in (1000, 4000):
        text = " ".join(f"word{i} Released under the MIT License. other{i}" for i in range(n))
        start = time.process_time()
        found = scanner.scan(text)
        took.append(time.process_time() - start)
        assert len(found) == n and all(x[0] == "MIT-notice" for x in found)
    assert took[1] < 8 * took[0] + 0.5


def test_every_template_is_found_in_prose():
    scanner = li.Scanner(li.TEMPLATES, 0.8)
    for name, text in li.TEMPLATES.items():
        found = scanner.scan(f"Some prose before it. {text} And some after it.")
        assert (name, 1.0) in {(x[0], x[1]) for x in found}, name
