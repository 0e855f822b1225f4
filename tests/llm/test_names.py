import random
from itertools import combinations

import pytest
from hypothesis import given
from hypothesis import strategies as st

from codexmill.llm import entities
from codexmill.llm.names import called, is_placeholder, near, parse_house, parse_person, slip_keys

SCHEMA = "kind string, content string, opf2_file_as string, name string"


def distance(a, b):
    """Optimal string alignment distance."""
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


@given(st.text("abc", max_size=6), st.text("abc", max_size=6))
def test_near(a, b):
    assert near(a, b) == (distance(a, b) <= 1)


@pytest.mark.parametrize(
    ("text", "family", "given", "initial", "middle"),
    [
        ("Leonardo van der Tedo-Vaboro", "van der tedo-vaboro", "leonardo", "l", ""),
        ("van der Tedo-Vaboro, Leonardo C.", "van der tedo-vaboro", "leonardo", "l", "c"),
        ("Nematarova, D. van der", "van der nematarova", "", "d", ""),
        ("Mr. BOB  KEPANEDABE, Ph.D.", "kepanedabe", "robert", "r", ""),
        ("Famotihafe Hanna", "famotihafe", "johanna", "j", ""),
        ("Belunaliki S.", "belunaliki", "", "s", ""),
        ("Otti Von Tisiboséha (transl.)", "von tisiboseha", "ottilie", "o", ""),
        ("Romenatumo Stephanie A.", "romenatumo", "stephanie", "s", "a"),
        ("Gotatekinu Urich", "gotatekinu", "ulrich", "u", ""),
        ("Plato", "plato", "", "", ""),
    ],
)
def test_person(text, family, given, initial, middle):
    got = parse_person(text)
    assert (got["surname"], got["given"], got["initial"], got["middle"]) == (family, given, initial, middle)


def test_houses_and_placeholders():
    assert {parse_house(t)["stem"] for t in ("Notetipelo & Sons, Inc.", "The Notetipelo and Sons", "and Sons, Notetipelo")} == {"notetipelo"}
    assert all(map(is_placeholder, ("", " ", "N/A", "unknown author", "Anonymous", "[s.n.]", "-")))


def run(spark, rows):
    return entities.spelling_pairs(entities.resolve(entities.name_strings(spark.createDataFrame(rows, SCHEMA))))


def test_groups(spark):
    ann = ["Robert Kepanedabe", "Kepanedabe, Bob", "R. Kepanedabe", "ROBT. KEPANEDABE", "Robert Kepandabe", "R. Kepanedbae"]
    other = ["Margaret Kepanedabe", "Peggy Kepanedabe"]
    both = ["Samuel Lanano", "Stephanie Lanano", "S. Lanano"]
    house = ["Movolosilu Books Limited", "Movoloislu Bks", "MOVOLOSILU BOOKS LTD"]
    rows = [("creator", n, None, "x") for n in ann + other + both + ["Anonymous", "N/A", "", None]] + [("publisher", n, "Anonymous", "y") for n in house] + [("title", "R Kepanedabe", None, "z")]
    want = {tuple(sorted(p)) for g in (ann, other, house) for p in combinations(g, 2)}
    assert {tuple(r) for r in run(spark, rows + rows).collect()} == want


def test_empty_and_long(spark):
    assert run(spark, []).count() == 0
    assert run(spark, [("creator", "x" * 5000, "y" * 5000, "")]).count() == 0


def test_given_names_outside_the_table(spark):
    one = ["Zbigniew Kepanedabe", "Zbigneiw Kepanedabe", "Kepanedabe, Zbign.", "Z. Kepanedabe"]
    two, three = ["Martin Lananole", "Lananole, Martni"], ["Martina Lananole"]
    apart = ["Zoran Famotihafe", "Zdenek Famotihafe", "Z. Famotihafe"]
    rows = [("creator", n, None, "x") for n in one + two + three + apart]
    want = {tuple(sorted(p)) for g in (one, two) for p in combinations(g, 2)}
    assert {tuple(r) for r in run(spark, rows).collect()} == want


def test_called():
    assert called(["zbigniew", "zbigneiw", "zbign", "zoran"]) == {"zbigniew": "zbigneiw", "zbigneiw": "zbigneiw", "zbign": "zbigneiw", "zoran": "zoran"}
    assert len(set(called(["samuel", "stephanie", "s"]).values())) == 3
    assert called(["mar", "marek", "marta"])["mar"] == "mar"
    assert called(["christop", "christopher"])["christop"] == "christopher"


def test_names_outside_the_table_in_either_order(spark):
    groups = [["Jennifer Okonkwo", "Jenifer Okonkwo", "Jenny Okonkwo", "Okonkwo Jennifer"], ["Mohammed Rahman", "Mohamed Rahman"], ["Robert Lang", "Robert Lagn"]]
    apart = ["Robert Land", "Darlene Okafor", "Marlene Okafor"]
    rows = [("creator", n, None, "x") for n in [*apart, *(n for g in groups for n in g)]]
    assert {tuple(r) for r in run(spark, rows).collect()} == {tuple(sorted(p)) for g in groups for p in combinations(g, 2)}


def test_middle_initials_count_per_given_name(spark):
    rows = [("creator", n, None, "x") for n in ("John A. Smithson", "James B. Smithson", "John Smithson", "James C. Smithson", "James Smithson")]
    assert {tuple(r) for r in run(spark, rows).collect()} == {("John A. Smithson", "John Smithson")}


def _slip(rng, word):
    i = rng.randrange(1, len(word) - 2)
    return word[:i] + word[i + 1] + word[i] + word[i + 2 :] if rng.random() < 0.5 and word[i] != word[i + 1] else word[:i] + word[i + 1 :]


def test_recall_on_names_outside_the_table(spark):
    """Invented people, each under several spellings: recall and precision of the pairs."""
    rng = random.Random(11)
    word = lambda n: "".join(rng.choice("bdfgklmnprstvz") + rng.choice("aeiou") for _ in range(n)) + rng.choice("lnrst")
    groups = []
    for _ in range(150):
        g, f = word(rng.choice((3, 4))).title(), word(rng.choice((3, 4))).title()
        forms = [f"{g} {f}", f"{f}, {g}", f"{f} {g}", f"{_slip(rng, g)} {f}", f"{g} {_slip(rng, f)}", f"{f}, {g[:4]}.", f"{g[0]}. {f}", f"{g.upper()} {f.upper()}"]
        groups.append(sorted(set(rng.sample(forms, rng.randrange(3, 7)))))
    want = {tuple(sorted(p)) for g in groups for p in combinations(g, 2)}
    got = {tuple(r) for r in run(spark, [("creator", n, None, "x") for g in groups for n in g]).collect()}
    both = len(want & got)
    assert both / len(want) >= 0.9, both / len(want)
    assert both / len(got) >= 0.95, both / len(got)


def test_called_is_fast_and_exact():
    """A block of many names: the look-up finds what comparing all pairs finds."""
    rng = random.Random(3)
    names = sorted({"".join(rng.choice("abl") for _ in range(rng.randrange(5, 9))) for _ in range(300)})
    shares = lambda a, b: bool(slip_keys(a) & slip_keys(b))
    assert all(shares(a, b) for a in names[:80] for b in names if near(a, b))
    assert len(called([f"{rng.getrandbits(64):x}" for _ in range(50_000)])) == 50_000
