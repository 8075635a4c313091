import html
import html.entities
from datetime import UTC
from email.utils import parsedate_to_datetime

import pytest
from pyspark.sql import functions as F

from tidings import fixed_values as fixed
from tidings.functions import replies as R
from tidings.functions import text as T
from tidings.functions.times import published_time, table_time


def apply(spark, column, values):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    rows = frame.select("i", column(F.col("v")).alias("r")).orderBy("i").collect()
    return [row["r"] for row in rows]


def test_clean_text(spark):
    cases = {
        None: "",
        "": "",
        "A &amp;amp; B": "A &amp; B",
        "&lt;b&gt;x&lt;/b&gt;": "x",
        "a&nbsp;&nbsp;b": "a b",
        "1 < 2 > 0": "1 0",
        "<p><br/></p>": "",
        " a\r\n\tb　c  ": "a b c",
        "caf&eacute &#233; &#xe9;": "café é é",
        "x\x1cy": "x y",
    }
    assert apply(spark, T.clean_text, cases) == list(cases.values())


def test_clean_summary_text(spark):
    cases = {
        None: "",
        "a\r\nb\rc": "a\nb\nc",
        "a\n\n\n\nb": "a\n\nb",
        "a  \t b\n   c": "a b\nc",
        "<i>a</i>&amp;b\n": "a &b",
    }
    assert apply(spark, T.clean_summary_text, cases) == list(cases.values())


def test_sentences_and_fallback(spark):
    assert apply(spark, T.sentences, ["One. Two! Three? Four", "e.g. x", "  ", "no stop"]) == [
        ["One.", "Two!", "Three?", "Four"],
        ["e.g.", "x"],
        [],
        ["no stop"],
    ]
    pad = fixed.PAD_LINE
    assert apply(spark, T.fallback_summary, ["A. B! C? D.", " A.\n\nB ", "x", " \n", None]) == [
        "A.\nB!\nC?",
        f"A.\nB\n{pad}",
        f"x\n{pad}\n{pad}",
        "Summary unavailable.",
        "Summary unavailable.",
    ]


def test_labels_and_strip(spark):
    assert apply(spark, T.label_name, ["foo_bar-baz", "--", None, "TECH", " a__b "]) == [
        "Foo Bar Baz", "Unknown", "Unknown", "Tech", "A B",
    ]
    assert apply(spark, T.strip, ["  a b \n\x1f", None]) == ["a b", None]


@pytest.mark.parametrize("words", [["trial", "İt"], fixed.CRIME_KEYWORDS])
def test_keywords_match_inside_words(spark, words):
    found = apply(spark, lambda c: T.contains_any(c, words), ["InduStrial", "nothing", None])
    assert found == [True, False, False]


FOLDED = {
    "\u00b5": "\u03bc", "\u03c2": "\u03c3", "\u017f": "s", "\u0130": "i", "\u0131": "i", "\u212a": "k",
    "\u00c9": "\u00e9",
}


@pytest.mark.parametrize("more", [0, 7, 8, 68])
@pytest.mark.parametrize("whole", [False, True])
def test_keywords_mean_the_same_in_lists_of_any_length(spark, more, whole):
    others = [f"zz{place}zz" for place in range(more)]
    for odd, plain in FOLDED.items():
        for word, text in ((f"a{odd}b", f"5 a{plain}b ."), (f"a{plain}b", f"5 A{odd}B .")):
            found = apply(spark, lambda c: T.contains_any(c, [word, *others], whole), [text, "5 ab ."])
            assert found == [True, False], (word, text)
    assert apply(spark, lambda c: T.contains_any(c, [], whole), ["a", None]) == [False, False]


def test_keywords_fold_odd_letters(spark):
    many = lambda c: T.contains_any(c, fixed.CRIME_KEYWORDS)
    few = lambda c: T.contains_any(c, ["crime", "assault"])
    texts = ["CRİME", "crıme", "aſsault", "CRIME", "crme", "a.c"]
    want = [True, True, True, True, False, False]
    assert apply(spark, many, texts) == want
    assert apply(spark, few, texts) == want


def test_whole_words(spark):
    found = apply(spark, lambda c: T.contains_any(c, ["trial"], True), ["industrial", "A Trial."])
    assert found == [False, True]


def test_json_payload(spark):
    cases = {
        '```json\n[{"id": 1},]\n```': '[{"id": 1}]',
        'Sure: {"items": [1, 2,]} ok': "[1, 2]",
        'see {"a": 1, } end': '{"a": 1}',
        "  prose ": "prose",
        "": "",
        None: "",
        '[{"s": "a,]"}]': '[{"s": "a]"}]',
    }
    assert apply(spark, R.repaired_payload, cases) == list(cases.values())


def test_refused_by_status(spark):
    refused = lambda status: lambda c: R.is_rate_limited(c, F.lit(status).cast("int"))
    assert apply(spark, refused(429), ["slow down", None]) == [True, True]
    assert apply(spark, refused(500), ["slow down", "quota"]) == [False, True]
    assert apply(spark, refused(None), [None]) == [False]


def test_rate_limit_and_content(spark):
    assert apply(spark, R.is_rate_limited, ["Error 429", "Resource Exhausted", "boom", None]) == [
        True, True, False, False,
    ]
    body = '{"choices":[{"message":{"content":"hi"}}]}'
    content = lambda status: lambda c: R.reply_content(F.lit(status), c)
    assert apply(spark, content(200), [body, '{"choices":[]}', "junk", None]) == [
        "hi", None, None, None,
    ]
    assert apply(spark, content(500), [body]) == [None]


def test_indented_lines(spark):
    assert apply(spark, T.indented, ["a\r\nb\x0cc d"]) == ["   a\n   b\n   c\n   d"]


def test_entities_as_html_reads_them(spark):
    names = list(html.entities.html5)
    cases = [f"a &{name} b" for name in names] + [f"&{name.rstrip(';')}x;" for name in names[::7]]
    cases += [f"&#{point};" for point in [*range(0, 300), 0xD7FF, 0xD800, 0xDFFF, 0xE000, 0xFDD0, 0xFFFD, 0xFFFE, 0x1FFFF, 0x1F600, 0x10FFFF, 0x110000]]
    cases += ["&#x1f600;&#X41", "&#65&#66;", "&#99999999999999999999;", "&#xffffffffffffffffffff;", "&#;", "&#x;", "&#xg;", "&", "&&amp;&", "& amp;"]
    cases += ["&notit;", "&notin;", "&ampamp;", "&amp;amp;", "&" + "a" * 40 + ";", "&lt", "x&lt<y", "&copy2024", "&nosuch;", "", "no reference", "&\n;", "&é;", "&am"]
    assert apply(spark, T.decode_entities, cases + [None]) == [html.unescape(case) for case in cases] + [None]


def test_cleaning_needs_no_python(spark):
    frame = spark.createDataFrame([("a &amp; b",)], "x string")
    plan = frame.select(T.clean_text(F.col("x")), T.clean_summary_text(F.col("x")))._jdf.queryExecution().executedPlan().toString()
    assert "EvalPython" not in plan


def shown(column):
    return lambda c: F.date_format(column(c), "yyyy-MM-dd HH:mm:ss")


def test_feed_times(spark):
    cases = {
        "Mon, 01 Jan 2024 10:00:00 +0530": "2024-01-01 04:30:00",
        "Mon, 1 Jan 2024 10:00:00 GMT": "2024-01-01 10:00:00",
        "1 Jan 2024 10:00": "2024-01-01 10:00:00",
        "01 Jan 2024 10:00:00 EST": "2024-01-01 15:00:00",
        "2024-01-01T10:00:00+05:30": "2024-01-01 04:30:00",
        "2024-01-01 10:00:00": "2024-01-01 10:00:00",
        "2024-01-01": "2024-01-01 00:00:00",
        "10:00": None,
        "garbage": None,
        "": None,
        None: None,
    }
    assert apply(spark, shown(published_time), cases) == list(cases.values())


MAIL_DATES = [
    "Tue, 03 Jun 2025 10:00:00 GMT", "Tue, 3 Jun 2025 10:00:00 +0530", "3 Jun 2025 10:00:00 -0800",
    "03 Jun 25 10:00:00 +0000", "03 Jun 68 10:00:00 GMT", "03 Jun 69 10:00:00 GMT", "3 June 2025 10:00:00 GMT",
    "Tue 3 Jun 2025 10:00:00 GMT", "Tuesday, 3 June 2025 10:00:00 GMT", "tue, 3 jun 2025 10:00:00 gmt",
    "TUE, 3 JUN 2025 10:00:00 GMT", "3 Jun 2025 10:00:00 EST", "3 Jun 2025 10:00:00 EDT",
    "3 Jun 2025 10:00:00 CST", "3 Jun 2025 10:00:00 CDT", "3 Jun 2025 10:00:00 MST", "3 Jun 2025 10:00:00 MDT",
    "3 Jan 2025 10:00:00 PST", "3 Jan 2025 10:00:00 PDT", "3 Jan 2025 10:00:00 AST", "3 Jan 2025 10:00:00 ADT",
    "3 Jun 2025 10:00:00 est", "3 Jun 2025 10:00:00 Z", "3 Jun 2025 10:00:00 UT", "3 Jun 2025 10:00:00 UTC",
    "3 Jun 2025 10:00:00 CET", "3 Jun 2025 10:00:00", "3 Jun 2025 10:00", "Tue, 3 Jun 2025 10:00 +0200",
    "3 Jun 2025 9:05:07 -0330", "31 Dec 2024 23:59:59 -0001", "1 Jan 2025 00:00:00 +1400", "29 Feb 2024 12:00:00 GMT",
    "29 Feb 2025 12:00:00 GMT", "32 Jan 2025 12:00:00 GMT", "3 Jun 2025 24:00:00 GMT", "Tue Jun  3 10:00:00 2025",
    "Tue Jun  3 10:00:00 EST 2025", "June 3, 2025 10:00:00 GMT", "Tue, Jun 3 2025 10:00:00 +0100",
    "3-Jun-2025 10:00:00 GMT", "Tuesday, 03-Jun-25 10:00:00 GMT", "3 Jun 2025 10:00:00 -0000",
    "3 Jun 2025 10:00:00 +0200 (CEST)", "Sept 3 2025", "3 Juno 2025 10:00:00 GMT", "x 3 Jun 2025 10:00:00 GMT", "10:00:00", "",
]


def by_mail_rules(text):
    """The standard library's reading as UTC; a date without a zone is UTC."""
    try:
        parsed = parsedate_to_datetime(text)
        return (parsed if parsed.tzinfo else parsed.replace(tzinfo=UTC)).astimezone(UTC).strftime("%Y-%m-%d %H:%M:%S")
    except (ValueError, TypeError):
        return None


def test_mail_dates_by_the_rules(spark):
    found = apply(spark, shown(published_time), MAIL_DATES)
    assert dict(zip(MAIL_DATES, found, strict=True)) == {text: by_mail_rules(text) for text in MAIL_DATES}


def test_first_valid_time_wins(spark):
    when = lambda c: published_time(F.lit("soon"), c)
    assert apply(spark, shown(when), ["2024-01-02"]) == ["2024-01-02 00:00:00"]


def test_table_times(spark):
    cases = {
        "20240101": "2024-01-01 00:00:00",
        "20240101101112": "2024-01-01 10:11:12",
        "2/3/2024": "2024-02-03 00:00:00",
        " 2024-01-01T10:00:00Z ": "2024-01-01 10:00:00",
        "20249999": None,
        "x": None,
        None: None,
    }
    assert apply(spark, shown(table_time), cases) == list(cases.values())
