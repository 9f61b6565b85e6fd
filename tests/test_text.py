import html
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from quire.functions import glyphs, values
from quire.functions import text as tx


def one(spark, column, **row):
    df = spark.range(1)
    for k, v in row.items():
        df = df.withColumn(k, F.lit(v))
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize("said", ["", " ", "a", "　a　", "\x1c\x1fa b\x1d\n", " x ", "\t\v\f\r"])
def test_strip_is_pythons(spark, said):
    assert one(spark, tx.strip(F.col("t")), t=said) == said.strip()


def test_control_characters(spark):
    said = "a\u0007b​c­de\n"
    want = "".join(c for c in said if unicodedata.category(c)[0] != "C")
    assert one(spark, tx.drop_control(F.col("t")), t=said) == want
    assert one(spark, tx.drop_control_exact(F.col("t")), t=said) == want


def test_entities(spark):
    said = "&lt;b&gt; &amp;lt; &quot;x&quot; &#39;&eacute;&#x27; &nbsp;"
    assert one(spark, tx.unescape(F.col("t")), t=said) == html.unescape(said)
    basic = "&lt;b&gt; &amp;lt; &quot;x&quot; &#39;"
    assert one(spark, tx.unescape_basic(F.col("t")), t=basic) == html.unescape(basic)


@pytest.mark.parametrize(
    ("said", "want"),
    [("<think>a</think>b<think>c</think>", "b<think>c</think>"), ("plain", "plain"), ("x<think>a</think>", "x<think>a</think>"), ("<think>\na\n</think>\n\nb", "\n\nb"), ("<think></think>b", "<think></think>b")],
)
def test_thought_block(spark, said, want):
    assert one(spark, tx.drop_thought(F.col("t")), t=said) == want == re.sub(r"^<think>.+?</think>", "", said, count=1, flags=re.S)


def test_tolerant_thought_block(spark):
    for said in ("<think>a\n</think>\n</think>\n\nb ", " <think>a</think> b", "b"):
        want = re.sub(r"^<think>.+?\n*(</think>|\n)*(</think>)\n*", "", said.strip(), flags=re.S).strip()
        assert one(spark, tx.drop_thought_tolerant(F.col("t")), t=said) == want


def test_templates(spark):
    cols = (F.lit("en"), F.lit("zh"), F.lit("${lang_in} $5"))
    assert one(spark, tx.render("${lang_in}>${lang_out}: ${text} ${other}", *cols)) == "en>zh: ${lang_in} $5 ${other}"
    assert one(spark, tx.render_exact("$lang_in>${lang_out} $$ $other: $text", *cols)) == "en>zh $ $other: ${lang_in} $5"
    said = one(spark, tx.messages(None, F.lit("en"), F.lit("zh"), F.lit("hello {v1}")))
    assert [m.role for m in said] == ["user"] and "hello {v1}" in said[0].content


def test_services_and_languages(spark):
    parts = one(spark, tx.service_parts(F.lit("ollama:gemma2:9b")))
    assert (parts.name, parts.model) == ("ollama", "gemma2:9b")
    assert one(spark, tx.service_parts(F.lit("google"))).model is None
    assert one(spark, tx.language_alias(F.lit("ZH"), {"zh": "zh-CN"})) == "zh-CN"
    assert one(spark, tx.language_word(F.lit("zh-TW"))) == "Chinese"
    with pytest.raises(Exception, match="unknown language"):
        one(spark, tx.language_word(F.lit("xx")))
    assert one(spark, tx.font_file(F.lit("zh-TW"))) == "SourceHanSerifTW-Regular.ttf"
    assert one(spark, tx.font_file(F.lit("RU"))) == one(spark, tx.font_file(F.lit("xx"))) == values.PAN_SCRIPT_FONT
    assert one(spark, tx.line_height(F.lit("xx"))) == 1.1


def test_names(spark):
    for path, want in (("/a/b.pdf", "b"), ("b.tar.pdf", "b.tar"), (".pdf", ".pdf"), ("a/b", "b")):
        assert one(spark, tx.stem(F.lit(path))) == want
    beside = one(spark, tx.output_names(F.lit("/a/b/c.pdf")))
    assert (beside.mono, beside.dual) == ("/a/b/c-mono.pdf", "/a/b/c-dual.pdf")
    assert one(spark, tx.output_names(F.lit("c.pdf"), F.lit("out/"))).mono == "out/c-mono.pdf"


def test_marks(spark):
    assert one(spark, tx.placeholder_numbers(F.lit("a {v0} { v 1 2 }{V3}{w4}"))) == [0, 12, 3]
    for said, want in (("{v12}", True), (" ", True), ("{v1} ", False), ("{v}", False), ("a", False)):
        assert one(spark, tx.untranslatable(F.lit(said))) is want


def test_formula_glyphs(spark):
    def want(font, ch):
        if ch.startswith("(cid:") or re.match(values.FORMULA_FONTS, font.split("+")[-1]):
            return True
        return ch != " " and (unicodedata.category(ch[0]) in values.FORMULA_CATEGORIES or 0x370 <= ord(ch[0]) < 0x400)

    rows = [(f, c) for f in ("Times", "AB+CMMI10", "CMR10", "Helvetica-Italic", "XYZ", "MSBM") for c in ("a", " ", "α", "+", "=", "∑", "ʰ", "́", " ", "(cid:3)", "5")]
    df = spark.createDataFrame(rows, "f string, c string").select("f", "c", glyphs.is_formula_glyph(F.col("f"), F.col("c")).alias("x"))
    assert {(r.f, r.c): r.x for r in df.collect()} == {(f, c): want(f, c) for f, c in rows}


def test_codes(spark):
    r = random.Random(1)
    for _ in range(20):
        said = "".join(chr(r.choice([65, 233, 0x4E00, 0x1F600, 32])) for _ in range(r.randrange(12)))
        assert one(spark, glyphs.encoded(F.lit(said), F.lit(True))) == "".join(f"{ord(c):04x}" for c in said)
        assert one(spark, glyphs.encoded(F.lit(said), F.lit(False))) == "".join(f"{ord(c):02x}" for c in said)


def test_operators_as_text(spark):
    args = (10.0, 1.25, -3.5)
    assert one(spark, glyphs.text_op(F.lit("tiro"), *[F.lit(x) for x in args], F.lit("0041"))) == glyphs.text_op_bytes("tiro", *args, "0041") == "/tiro 10.000000 Tf 1 0 0 1 1.250000 -3.500000 Tm [<0041>] TJ "
    line = (1.0, 2.0, 30.0, 0.0, 0.5)
    assert one(spark, glyphs.line_op(*[F.lit(x) for x in line])) == glyphs.line_op_bytes(*line)
