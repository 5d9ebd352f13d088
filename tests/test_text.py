"""X1-X11 and P19 against FIXTURES.md §2.4-2.5."""

from pyspark.sql import functions as F

from tradelens.functions import synonyms as S
from tradelens.functions import text as X


def _apply(spark, expr, values):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    return [r[0] for r in df.select(expr).collect()]


def test_normalize_and_diacritics(spark):
    assert _apply(spark, X.normalize_text(F.col("v")), ["  CÔNG   TY  ABC ", "a \tb\n"]) == ["công ty abc", "a b"]
    assert _apply(spark, X.normalize_text(F.col("v"), remove_accents=True), ["Điện Tử"]) == ["dien tu"]
    assert _apply(spark, X.strip_vietnamese(F.col("v")), ["Tôm đông lạnh"]) == ["tom dong lanh"]
    assert _apply(spark, X.remove_diacritics(F.col("v")), ["Crème Brûlée Đà Nẵng"]) == ["Creme Brulee Da Nang"]


def test_nfc(spark):
    assert _apply(spark, X.nfc(F.col("v")), ["ệ"]) == ["ệ"]


def test_nfc_of_all_scripts(spark):
    import random
    import unicodedata

    words = ["ș ț Ș", "nǐ hǎo ǚ", "ḍ ẛ̣ ḹ", "ё й ў", "ά ῷ ΐ", "が パ ヴ", "한국어 각", "क़ ড়", "ொ ൌ", "Å Ω ; ·", "豈", "שׁ", "ế đ", "𝅗𝅥 𑄮", "plain", "", None]
    rows = [unicodedata.normalize(f, w) if w else w for w in words for f in ("NFD", "NFC")] + words + ["a\u0301\u0302", "x\u0323\u0307\u0323"]
    rng = random.Random(4)
    pool = "aeou\u0301\u0302\u0323\u031b\u0308\u1100\u1161\u11a8\uac00\u3099か\u0438\u0306\u03b1\u0345\u0313 "
    rows += ["".join(rng.choice(pool) for _ in range(12)) for _ in range(300)]
    df = spark.createDataFrame([(r,) for r in rows], "v string")
    got = df.select("v", X.nfc("v").alias("n"), X.normalize_vietnamese("v").alias("t"), X.keywords("v", 1).alias("k")).collect()
    for r in got:
        want = r.v if r.v is None else unicodedata.normalize("NFC", r.v)
        assert r.n == want
        assert r.t == (want if want is None else " ".join(want.split()))
    assert df.filter(X.nfc("v") == "한국어 각").count() >= 2 and df.groupBy(X.searchable_text("v").alias("s")).count().count() > 100


def test_nfc_class_misses_nothing(spark):
    """Every character that is not stable under NFC alone or after another is in the class."""
    import sys
    import unicodedata

    chars = [chr(c) for c in range(1, sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    late = {y for x in chars for y in unicodedata.normalize("NFD", x)[1:] if unicodedata.normalize("NFC", x) == x}
    unstable = [x for x in chars if unicodedata.combining(x) or not unicodedata.is_normalized("NFC", x) or x in late]
    assert len(unstable) > 1500
    df = spark.createDataFrame([(x,) for x in unstable], "v string")
    assert df.filter(~F.col("v").rlike(X._NOT_COMPOSED)).count() == 0


def test_levenshtein(spark):
    df = spark.createDataFrame([("electonic", "electronic"), ("electonic", "electronics"), ("laptop", "desktop")], "a string, b string")
    assert [r[0] for r in df.select(X.levenshtein("a", "b")).collect()] == [1, 2, 4]
    assert [r[0] for r in df.select(X.levenshtein("a", "b", 1)).collect()] == [1, -1, -1]


def test_capitalize_and_keywords(spark):
    assert _apply(spark, X.capitalize_words(F.col("v")), ["công ty ABC-x", "straße ß"]) == ["Công Ty Abc-x", "Straße SS"]
    assert _apply(spark, X.keywords(F.col("v")), ["Tôm và cá của công ty"]) == [["tôm", "công"]]


def test_shorten_name(spark):
    a = "Tôm thẻ chân trắng đông lạnh - loại 1, đóng gói 10kg" + " x" * 40
    b = "Cá, tra" + " phi lê" * 20
    got = _apply(spark, X.shorten_name(F.col("v")), [a, b, "ngắn"])
    assert len(a) == 132 and len(b) == 147
    assert got == ["Tôm thẻ chân trắng đông lạnh - loại 1", b[:97] + "...", "ngắn"]


def test_truncate_at_word(spark):
    text = "word " * 30
    got = _apply(spark, X.truncate_at_word(F.col("v"), 20), [text, "short"])
    assert got == ["word word word word...", "short"]


def test_truncate_composes_the_start_only(spark):
    import unicodedata

    decomposed = unicodedata.normalize("NFD", "ệ ấ ữ tiếng Việt ") * 40
    marks = "a" + "\u0323\u0302" * 100 + " x" * 50
    texts = [decomposed, marks, "b" * 78 + "e\u0302\u0323" + "c" * 200, "d" * 319 + "e\u0301 z", "e" * 79 + "a" + "\u0301", "plain " * 200, None]
    got = _apply(spark, X.truncate_at_word(F.col("v"), 80), texts)
    for text, cut in zip(texts[:-1], got):
        whole = unicodedata.normalize("NFC", text)[:80]
        at = whole.rfind(" ")
        assert cut == (whole[:at] if at > 64 else whole) + "..."
    assert got[-1] is None
    df = spark.createDataFrame([("x",)], "v string").select(X.truncate_at_word(F.col("v"), 80).alias("r"))
    plan = df._jdf.queryExecution().optimizedPlan().toString().lower()
    assert plan.count("com.ibm.icu") == 2  # once for the start, once for the whole text: not at every mention of the cut


def test_keywords_split_every_space_alike(spark):
    texts = ["Một  hai\u00a0\u2003 Tôm\t\nđông  và lạnh ", " \u3000cá tra", "", "\u00a0", "a b  c\u2028d", None]
    got = _apply(spark, X.keywords(F.col("v"), 1), texts)
    stops = set(X.VI_STOP_WORDS)
    assert got == [[w for w in t.lower().split() if w not in stops] if t is not None else None for t in texts]
    plan = spark.createDataFrame([("x",)], "v string").select(X.keywords(F.col("v")).alias("r"))._jdf.queryExecution().optimizedPlan().toString()
    assert "array_contains" not in plan and plan.count("(?U)") == 1  # stop words are looked up by hash; one pass finds the white space


def test_parse_classification(spark):
    cases = [
        '{"category":"Nông sản","confidence":0.9}',
        'text {"category":"Khác"} tail',
        "category: Dệt may",
        "no idea",
    ]
    out = _apply(spark, X.parse_classification(F.col("v")), cases)
    assert [(r["category"], r["confidence"]) for r in out] == [("Nông sản", 0.9), ("Khác", 0.5), ("Dệt may", 0.5), ("Khác", 0.5)]


TRUE_PAIRS = [("USA", "Hoa Kỳ"), ("Vietnam", "VN"), ("Germany", "Đức"), ("Russia", "US"), ("Australia", "US"),
              ("Thanh Hoa", "UK"), ("Sweden", "Germany"), ("a", "US"), ("", "US")]
FALSE_PAIRS = [("China", "US"), ("Japan", "US"), ("France", "US"), ("Canada", "US"), ("Brazil", "US")]


def test_synonyms_reference_mode(spark):
    for a, b in TRUE_PAIRS:
        assert S.synonyms_py(a, b), (a, b)
    for a, b in FALSE_PAIRS:
        assert not S.synonyms_py(a, b), (a, b)
    # the Column form agrees with the driver form for every pair
    pairs = TRUE_PAIRS + FALSE_PAIRS
    df = spark.createDataFrame(pairs, "a string, b string")
    for (a, b), row in zip(pairs, df.collect()):
        got = df.filter((F.col("a") == a) & (F.col("b") == b)).select(S.synonym_match(F.col("a"), b)).first()[0]
        assert got == S.synonyms_py(a, b), (a, b)


def test_synonyms_exact_mode():
    for a, b in [("Russia", "US"), ("Australia", "US"), ("Thanh Hoa", "UK"), ("Sweden", "Germany"), ("a", "US"), ("", "US")]:
        assert not S.synonyms_py(a, b, mode="exact"), (a, b)
    assert S.synonyms_py("USA", "Hoa Kỳ", mode="exact")
