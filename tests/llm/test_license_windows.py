import random

import pytest

from bulletria.llm import license_scan, queries

PROSE = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor".split()


def prose(rng, n):
    return " ".join(rng.choice(PROSE) for _ in range(n))


@pytest.fixture(scope="module")
def scanned(spark, tmp_path_factory):
    """What op6's query finds in each text."""

    def run(texts):
        path = str(tmp_path_factory.mktemp("op6"))
        spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
        got = [{} for _ in texts]
        for r in queries.op6_license_scan(spark, path).collect():
            got[r.doc_id][r.license] = r.score
        return got

    return run


def test_embedded_licenses(scanned):
    rng = random.Random(3)
    body = next(b for name, b in license_scan.TEMPLATES if name == "MIT" and len(b) > 500)
    split = body.replace("The above copyright", "\n\nThe above copyright").replace("THE SOFTWARE IS", "\n\nTHE SOFTWARE IS", 1)
    wrapped = "\n".join(" ".join(split.replace("\n\n", " ").split()[i : i + 12]) for i in range(0, 200, 12))
    got = scanned([
        *(f"{prose(rng, n)}\n\n{split}\n\n{prose(rng, n)}" for n in (0, 100, 200, 3000)),
        f"{prose(rng, 50)}\n{wrapped}\nint main() {{ return 0; }} {prose(rng, 500)}",
        "Released under the MIT License. See the file for details of it.",
        prose(rng, 400),
    ])
    assert [r.get("MIT") for r in got[:6]] == [1.0] * 6
    assert got[6] == {}


def test_window_scores_are_dice():
    rng = random.Random(4)
    matcher = license_scan.Matcher([("A", "a b c d e f g h")], 0.8)
    for _ in range(200):
        unit = [rng.choice("abcdefghij") for _ in range(8)] + list("abcdefgh")[: rng.randrange(9)] + [rng.choice("abcdefghij") for _ in range(8)]
        grams = list(zip(unit, unit[1:]))
        own = set(zip("abcdefg", "bcdefgh"))
        want = max(2 * len(set(grams[i : i + w]) & own) / (len(set(grams[i : i + w])) + 7) for w in range(7, 11) for i in range(len(grams) - w + 1))
        got: dict[str, float] = {}
        matcher.slide(unit, got)
        assert got.get("A", 0) == pytest.approx(want if want >= 0.8 else 0)


def test_openings_and_notices_within_other_text(scanned):
    rng = random.Random(5)
    by_name = {}
    for name, body in license_scan.TEMPLATES:
        by_name.setdefault(name, []).append(body)
    texts = [(name, f"{prose(rng, 300)} {body} {prose(rng, 300)}") for name, bodies in by_name.items() for body in bodies if len(body) > 60]
    long = f"{prose(rng, 40_000)} {by_name['Zlib'][0]} {prose(rng, 40_000)}"
    same = [texts[0][1]] * 3
    got = scanned([t for _, t in texts] + [long] + same)
    assert all(r.get(name) == 1.0 for r, (name, _) in zip(got, texts))
    assert got[len(texts)] == {"Zlib": 1.0} and got[-1] == got[-2] == got[-3] == got[0]
