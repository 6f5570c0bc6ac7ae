import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from pressgauge.functions import fingerprints, intake, matching


def rows_of(spark, values, **columns):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    out = df.select("i", *[c.alias(n) for n, c in columns.items()]).orderBy("i").collect()
    return out


def py_headline(text):
    for fancy, plain in matching.LOOKALIKES.items():
        text = text.replace(fancy, plain)
    text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return " ".join(re.sub("[^a-z0-9]+", " ", text.lower().replace("'", "")).split())


def py_simple(text):
    text = unicodedata.normalize("NFKD", text).lower().replace("'", "")
    return " ".join(re.sub("[^a-z0-9]+", " ", text).split())


@pytest.fixture(scope="module")
def samples(sf_dir):
    import pyarrow.parquet as pq

    texts = pq.read_table(f"{sf_dir}/documents.parquet", columns=["text"]).column(0).to_pylist()
    blocks = [(0x20, 0x3100), (0xA640, 0xABFF), (0xF900, 0xFFFE), (0x1D400, 0x1D800), (0x1F100, 0x1F200)]
    chars = [f"Ab{chr(c)}cD {chr(c)} x" for lo, hi in blocks for c in range(lo, hi)]
    return texts + chars


def test_keys_equal_python_restatement(spark, samples):
    got = rows_of(
        spark, samples, n=matching.normalize_headline(F.col("t")), s=matching.simple_key(F.col("t"))
    )
    assert [(r.i, r.n) for r in got if r.n != py_headline(samples[r.i])] == []
    assert [(r.i, r.s) for r in got if r.s != py_simple(samples[r.i])] == []


@pytest.mark.parametrize(
    "left,right",
    [
        ("Trump’s plan", "trumps plan"),
        ("  too   many \n spaces  ", "too many spaces"),
        ("Café — open!", "cafe open"),
        ("A-B – C", "a b c"),
        ("!!! ---", ""),
        ("", ""),
        (None, ""),
    ],
)
def test_headline_cases(spark, left, right):
    assert rows_of(spark, [left], k=matching.normalize_headline(F.col("t")))[0].k == right


def test_body_key(spark):
    words = [f"w{i}" for i in range(30)]
    got = rows_of(
        spark,
        [" ".join(words[:19]), " ".join(words[:20]), " ".join(words), '"' + " ".join(words) + '"', None],
        k=matching.body_key(F.col("t")),
    )
    whole = " ".join(words[:20])
    assert [r.k for r in got] == ["", whole, whole, whole, ""]


def test_joined_parts_give_the_key_of_the_joined_paste(spark, samples):
    texts = samples[:200]
    got = rows_of(
        spark,
        texts,
        whole=matching.normalize_headline(F.concat(F.col("t"), F.lit("\n"), F.reverse("t"))),
        parts=F.trim(
            F.concat_ws(" ", matching.normalize_headline(F.col("t")), matching.normalize_headline(F.reverse("t")))
        ),
    )
    assert all(r.whole == r.parts for r in got)


def test_paste_extract_display(spark):
    got = rows_of(
        spark,
        ["\n  Head \n body\nmore ", "only head", "x" * 600, "y" * 601, "z" * 500, None],
        p=matching.split_paste(F.col("t")),
        e=matching.build_extract(F.col("t")),
        d=matching.display_headline(F.col("t"), F.lit("")),
    )
    assert tuple(got[0].p) == ("Head", "body\nmore")
    assert tuple(got[1].p) == ("only head", "")
    assert got[2].e == "x" * 600 and got[3].e == "y" * 600 + "..." and got[5].e == ""
    assert got[3].d.headline == "y" * 497 + "..." and got[3].d.body == "y" * 601
    assert got[4].d.headline == "z" * 500 and got[4].d.body == ""


MARKED = [
    "WASHINGTON (Reuters) - The Senate voted.",
    "NEW YORK/LONDON (AP) — Stocks fell. Reporting by Jeff Mason; Editing by Peter Cooney",
    "Featured image via Getty Images. Then text. Photo by AP Photo",
    "See https://t.co/abc or www.site.com/x and pic.twitter.com/zz now",
    "[VIDEO] Watch: this (WATCH) and Read more about us on the site. End",
    "Éreuters reutersé reuters’ Associated Press Agence France-Presse",
    "Follow us on Twitter and more. Subscribe to our list",
    "nothing here",
    "",
]


def test_fingerprints_equal_python(spark, samples):
    texts = MARKED + [m + " " + s for m in MARKED for s in samples[:40]]
    rules = [(n, re.compile(p, re.I if ic else 0)) for n, p, ic in fingerprints.RULES]

    def cleaned(text):
        for _, rule in rules:
            text = rule.sub(" ", text)
        return re.sub(r"\s+", " ", text).strip()

    def counted(text):
        counts = {n: len(rule.findall(text)) for n, rule in rules}
        return {n: c for n, c in counts.items() if c}

    got = rows_of(
        spark,
        texts,
        c=fingerprints.clean_article_text(F.col("t")),
        m=fingerprints.count_fingerprints(F.col("t")),
    )
    assert [r.c for r in got] == [cleaned(t) for t in texts]
    assert [r.m for r in got] == [counted(t) for t in texts]


def test_measurements_equal_python(spark, samples):
    # The JVM's Unicode tables may be older than Python's: keep to characters both know.
    known = [s for s in samples if not any(unicodedata.ucd_3_2_0.category(c) == "Cn" for c in s)]
    texts = known + ["it's the end", "...", "", "ال text", "I'M OF THE"]
    markers = set(intake.ENGLISH_MARKERS)

    def latin(t):
        letters = [c for c in t if c.isalpha()]
        return sum(c.isascii() for c in letters) / len(letters) if letters else 0.0

    def english(t):
        words = re.findall("[a-zA-Z']+", t.lower())
        return sum(w in markers for w in words) / len(words) if words else 0.0

    got = rows_of(
        spark,
        texts,
        w=intake.word_count(F.col("t")),
        la=intake.latin_share(F.col("t")),
        en=intake.english_share(F.col("t")),
    )
    for r in got:
        t = texts[r.i]
        assert r.w == len(re.findall(r"[\w'-]+", t))
        assert abs(r.la - latin(t)) < 1e-12
        assert abs(r.en - english(t)) < 1e-12


def test_gate(spark):
    english = "The cat of the house was in the garden and it is on the wall with all of the birds. " * 3
    spanish = "El gato de la casa estaba en el jardin con todos los pajaros del barrio viejo. " * 3
    texts = ["Trump Wins Iowa Caucus", english, "یہ خبر", spanish, "word " * 600, "   ", None]
    got = rows_of(spark, texts, p=intake.check_input(F.col("t")), s=intake.check_long_enough(F.col("t")))
    assert [r.p.code if r.p else None for r in got] == [
        None, None, "not_english", "not_english_prose", "too_long", "empty", "empty",
    ]
    assert got[4].p.message.startswith("That is 600 words, and the limit is 400.")
    assert got[4].p.detail == {"words": 600.0}
    assert got[0].s.message.endswith("and at 4 words there is not enough text for our reading model "
                                     "to judge it. Paste at least 25 words.")
    assert got[1].s is None
    accepted, refused = intake.gate(spark.createDataFrame([(t,) for t in texts], "t string"), "t")
    assert accepted.count() == 2 and refused.count() == 5


def test_screened_rules_equal_rules_alone(spark):
    """Letters that only case-insensitive matching equates must pass the screen."""
    from pressgauge.functions import fingerprints as fp

    texts = ["v\u0130deo: x", "\u0130STOCK now", "Wr\u0130ting by A. B.", "\u017fcreen\u017fhot via me", "Sub\u017fcribe to our list", "\u212aiosk"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    alone = [F.regexp_count("t", F.lit(p)).alias(f"r{i}") for i, p in enumerate(fp.JAVA_PATTERNS)]
    screened = [c.alias(f"r{i}") for i, c in enumerate(fp.fingerprint_hits(F.col("t")))]
    assert df.select(*screened).collect() == df.select(*alone).collect()


def test_rules_settle_a_position_by_its_first_character(spark):
    from pressgauge.functions import fingerprints as fp

    bits = ["Reuters", "REUTERſ", "İstock", "ıstock", "shutterſtock", "press", "associated", "é", "_", "9", " ", "\t", "\xa0", "\x85", "(AP) - ", "NEW YORK", "[Video]"]
    bits += ["watch :", "photo by", "read more", "follow us on", "editing by", "www.x.y", "http://a.b", "t.co/x", "pic.twitter.com/y", ".", "\n", "K", "  ", "getty"]
    texts = [a + b + c for a in bits for b in ("", " ", "x") for c in bits]
    word_edge = r"(?:(?<=[\p{L}\p{N}_])(?![\p{L}\p{N}_])|(?<![\p{L}\p{N}_])(?=[\p{L}\p{N}_]))"
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = []
    for (rule, pattern, ignore_case), quick in zip(fp.RULES, fp.JAVA_PATTERNS):
        assert f"(?=[{fp.FIRST[rule]}])" in quick and word_edge not in quick
        for short, long in ((r"\b", word_edge), (r"\s", fp.SPACE), (r"\S", fp.NOT_SPACE)):
            pattern = pattern.replace(short, long)
        plain.append(F.regexp_replace("t", ("(?iu)" if ignore_case else "") + pattern, "#") == F.regexp_replace("t", quick, "#"))
    tidy = F.regexp_replace("t", f"{fp.SPACE}+", " ") == F.regexp_replace("t", fp.UNTIDY, " ")
    same = df.agg(*[F.min(c.cast("int")) for c in [*plain, tidy]]).first()
    assert set(same) == {1}
