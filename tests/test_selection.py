import random
from collections import Counter

import pytest

from pressgauge.operators import selection as sel

SCHEMA = "pos long, domain string, title string, content string, type string"


def walk(rows, cap, blocked, reals):
    """The rule restated one row at a time."""
    counts = Counter(r[1] for r in rows)
    held, full, out = set(), Counter(), {}
    for pos, raw, title, body, kind in sorted(rows, key=lambda r: (counts[r[1]], r[0])):
        site = (raw or "").strip() if reals else (raw or "(unknown)")
        key = (title or "").lower().strip()
        if not reals and kind not in sel.WANTED_TYPES:
            why = sel.UNUSED_LABEL
        elif reals and site in sel.NEVER_WANTED:
            why = f"excluded outlet ({site})"
        elif reals and site not in ("CNN", "Vox", "Axios"):
            why = sel.NOT_GENERAL
        elif len((body or "").strip()) < 5:
            why = sel.TOO_SHORT
        elif not key:
            why = sel.NO_HEADLINE
        elif key in blocked:
            why = sel.IN_TEST_SET
        elif key in held:
            why = sel.DUPLICATE
        elif full[site] >= cap:
            why = "full"
        else:
            why = None
            held.add(key)
            full[site] += 1
        out[pos] = why
    return out


@pytest.mark.parametrize("seed", range(8))
def test_selection_equals_walk(spark, seed):
    rng = random.Random(seed)
    reals = seed % 2 == 1
    sites = ["CNN", " CNN", "Vox", "Axios", "Reuters", "Other", None] if reals else ["a", "b", "c", "d", "e", None, ""]
    weights = [rng.random() ** 2 + 0.05 for _ in sites]
    rows = [
        (
            i,
            rng.choices(sites, weights)[0],
            rng.choice([None, "  "] + [f"T{rng.randrange(40)}"] * 20),
            rng.choice(["short body", "abc", "body text " * 2]),
            rng.choice(["fake", "rumor", "satire"]),
        )
        for i in range(250)
    ]
    blocked = {"t1", "t2"}
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    keys = spark.createDataFrame([(k,) for k in blocked], "key string")
    cap = rng.choice([2, 4, 9])
    if reals:
        spec = sel.reals_spec(cap, site="domain", body="content", min_chars=5, allow=["CNN", "Vox", "Axios"])
    else:
        spec = sel.fakes_spec(cap, min_chars=5)
    got = {r.pos: r.reason for r in sel.select_diverse(df, spec, keys).collect()}
    want = {p: (spec.full if w == "full" else w) for p, w in walk(rows, cap, blocked, reals).items()}
    assert got == want


def test_tally_profile_trim(spark):
    rows = [(i, "ab"[i % 2], f"t {i}", "x" * 10, "fake") for i in range(10)] + [(10, "c", "t 0", "x" * 10, "fake")]
    decided = sel.select_diverse(spark.createDataFrame(rows, SCHEMA), sel.fakes_spec(3, min_chars=5))
    assert {r.reason: r.articles for r in sel.rejection_tally(decided).collect()} == {
        "duplicate of one we kept": 1, "website already at its cap": 3,
    }
    profile = sel.selection_profile(decided).first()
    assert (profile.articles, profile.sites, profile.busiest_articles) == (7, 3, 3)
    assert [r.pos for r in sel.trim_to_target(decided, "pos", 4).orderBy("site_rows", "pos").collect()] == [10, 1, 2, 3]


def test_leaks_and_blocklist(spark):
    exam = spark.createDataFrame([("A b!",), ("new one",), ("",), (None,)], "title string")
    pile = spark.createDataFrame([("a B",), ("",)], "title string")
    other = spark.createDataFrame([(1,)], "n int")
    assert {r.title for r in sel.drop_leaks(exam, pile, other).collect()} == {"new one", "", None}
    assert [r.key for r in sel.taught_keys(pile, other).collect()] == ["a b"]


def contending(n):
    """n sites that all want the same n headlines and keep one each, and others that want nobody else's."""
    rows = [(site * 100 + k, f"s{site}", f"wanted {k}", "x" * 10, "fake") for site in range(n) for k in range(n)]
    return rows + [(5_000 + k, f"calm{k}", f"own {k}", "x" * 10, "fake") for k in range(5)]


@pytest.mark.parametrize("front", [sel.FRONT, 20, 5])
def test_contending_sites_settle_in_few_rounds(spark, monkeypatch, front):
    rows, writes, write = contending(9), [], sel.cut_lineage
    monkeypatch.setattr(sel, "FRONT", front)
    monkeypatch.setattr(sel, "cut_lineage", lambda df: writes.append(1) or write(df))
    spec = sel.fakes_spec(1, min_chars=5)
    got = {r.pos: r.reason for r in sel.select_diverse(spark.createDataFrame(rows, SCHEMA), spec).collect()}
    assert got == {p: (spec.full if w == "full" else w) for p, w in walk(rows, 1, set(), False).items()}
    # two pairs for each site that waits, taken off `front` at a time: the chain's length in sites does not count
    assert len(writes) <= 3 + 5 * -(-2 * len(rows) // front) if front < 86 else len(writes) <= 3


@pytest.mark.parametrize("seed", range(2))
def test_small_fronts_equal_the_walk(spark, monkeypatch, seed):
    rng = random.Random(seed)
    rows = [(i, rng.choice("abcdefgh"), f"T{rng.randrange(25)}", "body text", "fake") for i in range(200)]
    monkeypatch.setattr(sel, "FRONT", 30)
    spec = sel.fakes_spec(4, min_chars=5)
    got = {r.pos: r.reason for r in sel.select_diverse(spark.createDataFrame(rows, SCHEMA), spec).collect()}
    assert got == {p: (spec.full if w == "full" else w) for p, w in walk(rows, 4, set(), False).items()}
