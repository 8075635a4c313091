import re
import time

import pytest
from pyspark.sql import functions as F

from tidings import fixed_values as fixed
from tidings.operators.articles import newest_landed, newest_unique
from tidings.operators.corpus import keyword_subset
from tidings.plans.briefing import csv_briefing, feed_briefing
from tidings.plans.preparation import write_keyword_corpus
from tidings.sources.entry_scanner import TOKEN
from tidings.sources.feeds import (
    CHARS,
    ENTRIES,
    _some,
    feed_rejects,
    landed_feeds,
    parse_feeds,
    read_feeds,
    reject_reasons,
    scanned_entries,
)
from tidings.sources.labels import label_table, read_labels
from tidings.sources.tables import (
    breaks_lines,
    pick_column,
    profile,
    read_articles_csv,
    read_corpus,
    read_csv,
    resolve_columns,
    write_digests,
)

RSS = """<?xml version="1.0" encoding="UTF-8"?>
<rss version="2.0"><channel><title>c</title>
<item><title>One &amp;amp; two</title><link> http://a/1 </link>
<description><![CDATA[<p>Hello <b>you</b></p>]]></description>
<pubDate>Mon, 01 Jan 2024 10:00:00 +0530</pubDate></item>
<item><link>http://a/2</link></item>
<item><title></title><link></link></item>
</channel></rss>"""
ONE_ITEM = """<rss><channel><item><title>Only</title></item></channel></rss>"""
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><title>f</title>
<entry><title type="html">T</title><link rel="self" href="http://s"/><link href="http://alt"/>
<summary>s</summary><updated>2024-01-02T00:00:00Z</updated></entry></feed>"""
FEEDS = [("first", "u0"), ("second", "u1"), ("third", "u2")]


def raw(spark):
    rows = [(RSS, 0, 0), (ATOM, 1, 0), (ONE_ITEM, 2, 3), ("", 2, 0), ("<rss><chan", 2, 1)]
    return spark.createDataFrame(rows, "value string, feed_rank int, fetch bigint")


def test_feeds(spark):
    rows = parse_feeds(raw(spark), FEEDS).orderBy("feed_rank", "entry_index").collect()
    got = [(r.source, r.title, r.link, r.description) for r in rows]
    assert got == [
        ("first", "One & two", "http://a/1", "Hello you"),
        ("first", "Untitled", "http://a/2", ""),
        ("first", "", "", ""),
        ("second", "T", "http://alt", "s"),
        ("third", "Only", "", ""),
    ]
    assert [r.published for r in rows][3] == "2024-01-02T00:00:00Z"
    assert rows[4].entry_index == 3 << 32
    assert str(rows[0].published_ts) == "2024-01-01 04:30:00"


WILD = [
    # Three whole items, then one that is cut off.
    "<rss><channel>" + "".join(f"<item><title>t{k}</title><link>l{k}</link></item>" for k in range(3))
    + "<item><title>t3</ti",
    "<rss><channel><item><title>A & B</title><link>http://x?a=1&b=2</link></item></channel></rss>",
    "<rss><channel><item><title>A&nbsp;B</title></item><item><title>ok</title></item></channel></rss>",
    """<rdf:RDF xmlns:rdf="r" xmlns="s" xmlns:dc="d"><channel><items><rdf:Seq/></items></channel>
    <item rdf:about="u"><title>R</title><link>lr</link><dc:date>2024-01-02T00:00:00Z</dc:date></item></rdf:RDF>""",
    """<a:feed xmlns:a="w"><a:entry xml:lang="en"><a:title>P</a:title><a:link href="lp"/>
    <a:content>c</a:content></a:entry></a:feed>""",
    """<rss xmlns:content="c" xmlns:media="m"><channel><item><guid>http://g</guid><media:title>no</media:title>
    <title>G</title><content:encoded><![CDATA[<p>Long & <b>whole</b></p>]]></content:encoded></item>
    <item><guid isPermaLink="false">id-1</guid><title>H</title></item><item><title>I</b></title></item>
    </channel></rss>""",
    # What stands in a comment or CDATA begins nothing, and a bare "<" is text.
    """<?xml version="1.0"?><!DOCTYPE rss><rss><channel><!-- <item><title>no</title></item> -->
    <item><title>5 < 6</title><description>a <b or 5 <6, <![CDATA[<item id=1>x</item></rss>]]></description></item>
    <item><title><!-- hidden -->T<!-- <b> --></title><description>d<br>e<p>f</description></item></b></channel></rss>""",
    # An unclosed item ends where the next one begins or its holder ends; nested names are no fields.
    """<feed><entry><title>lost</title><entry><title type='a>b'>kept</title><source><title>outer</title></source>
    <link rel="self" href="s"/><link rel="alternate" href="l?a=1&amp;b=2"/><content type="xhtml"><div>1 &amp; 2
    <entry-x/></div></content></entry><entry><title>cut</feed>""",
    "<rss><channel><item/><ITEM><Title>C&#233;&#x26;&#0;</Title><PubDate>2024-01-02</PubDate></ITEM><item><![CDATA[ open",
]


def test_feeds_that_are_no_perfect_xml(spark):
    rows = [(text, 0, fetch) for fetch, text in enumerate(WILD)]
    wild = spark.createDataFrame(rows, "value string, feed_rank int, fetch bigint")
    found = parse_feeds(wild, FEEDS).orderBy("entry_index").collect()
    assert [(r.title, r.link, r.description) for r in found] == [
        ("t0", "l0", ""), ("t1", "l1", ""), ("t2", "l2", ""),
        ("A & B", "http://x?a=1&b=2", ""),
        ("A B", "", ""), ("ok", "", ""),
        ("R", "lr", ""), ("P", "lp", "c"),
        ("G", "http://g", "Long & whole"), ("H", "", ""), ("I", "", ""),
        ("5 < 6", "", "a x"), ("T", "", "d e f"),
        ("kept", "l?a=1&b=2", "1 & 2"), ("Cé&\ufffd", "", ""),
    ]
    assert str(found[6].published_ts) == "2024-01-02 00:00:00"
    rejects = {r.fetch: (r.n_entries, r.n_rejected) for r in feed_rejects(wild).collect()}
    reasons = {(r.fetch, r.cut_off): (r.n, r.first_position) for r in reject_reasons(wild).collect()}
    assert reasons == {
        (0, "document ends"): (1, 3), (7, "next entry begins"): (1, 0), (7, "holder ends"): (1, 2), (8, "document ends"): (1, 1),
    }
    assert rejects == {0: (4, 1), 1: (1, 0), 2: (2, 0), 3: (1, 0), 4: (1, 0), 5: (3, 0), 6: (2, 0), 7: (3, 2), 8: (2, 1)}


def test_csv_ids_do_not_depend_on_splits(spark, tmp_path):
    for name in ("a", "b"):
        lines = "".join(f"title {name}{k},text {k}\n" for k in range(3000))
        (tmp_path / f"{name}.csv").write_text("title,text\n" + lines)
    ids = []
    for size in ("128m", "9k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        found = read_articles_csv(spark, str(tmp_path), multi_line=False).collect()
        ids.append({r.article_id: (r.title, r.entry_index) for r in found})
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert ids[0] == ids[1] and len(ids[0]) == 6000
    assert ids[0] and all(title[7:] == str(place) for title, place in ids[0].values())


@pytest.mark.parametrize(
    ("text", "breaks"),
    [
        ("a,b\n", False),
        ('a,"b ""c"", d",""\n"x",y\n', False),
        ('a,"b\nc"\n', True),
        ('a,"b ""\nc"" "\n', True),
        ('a"b,"c\nd",e\n', True),
        ('5" disk,b\n', True),
        ('"","a\r\nb"\r\n', True),
        ("", False),
    ],
)
def test_line_breaks_inside_fields_are_found(spark, tmp_path, text, breaks):
    (tmp_path / "a.csv").write_bytes(b"x,y,z\n" + text.encode())
    assert breaks_lines(spark, str(tmp_path)) == breaks
    if not breaks:
        kept = [read_csv(spark, str(tmp_path), way).drop("row_in_split").collect() for way in (True, False, None)]
        assert kept[0] == kept[1] == kept[2]


def test_keyword_matches_are_found_once(spark, tmp_path):
    (tmp_path / "a.csv").write_text("text\n" + "".join(f"police {k}\ncalm\n" for k in range(40)))
    found = keyword_subset(read_csv(spark, str(tmp_path)), "text", ["POLICE"], 25)
    assert [row.text for row in found.collect()] == [f"police {k}" for k in range(25)]
    assert "ArrowEvalPython" not in found._jdf.queryExecution().executedPlan().toString()


def test_empty_title_is_not_untitled(spark):
    from tidings.sources.feeds import normalize_entries

    fields = "feed_rank int, fetch bigint, position int, title string, link string, summary string,"
    fields += "description string, published string, updated string"
    entries = spark.createDataFrame(
        [(0, 0, 0, "", "", None, "d", None, None), (0, 0, 1, None, "", "s", "d", "", "u")], fields
    )
    rows = normalize_entries(entries, FEEDS).orderBy("entry_index").collect()
    assert [(r.title, r.description, r.published) for r in rows] == [
        ("", "d", ""), ("Untitled", "s", "u"),
    ]


def test_feed_folder_and_briefing(spark, tmp_path):
    folder = str(tmp_path / "feeds")
    raw(spark).write.partitionBy("feed_rank", "fetch").text(folder)
    assert read_feeds(spark, folder, FEEDS).count() == 5
    tagged = feed_briefing(spark, folder)
    assert tagged.count() >= 4
    assert set(tagged.columns) >= {"raw_category", "category", "confidence", "scores"}


def test_newest_of_a_folder_reads_few_documents_twice(spark, tmp_path):
    folder = str(tmp_path / "feeds")
    rows = []
    for fetch in range(40):
        items = "".join(
            f"<item><title>t{fetch}-{k}</title><link>l{(fetch * 5 + k) % 90}</link><description>d{k}</description>"
            f"<pubDate>{1 + (fetch * 7 + k) % 28:02d} Jan 2024 {k:02d}:00:00 GMT</pubDate></item>"
            for k in range(12)
        )
        rows.append((f"<rss><channel>{items}</channel></rss>", fetch % 3, fetch))
    frame = spark.createDataFrame(rows, "value string, feed_rank int, fetch bigint")
    frame.write.partitionBy("feed_rank", "fetch").text(folder)
    found = newest_landed(spark, folder, 4, FEEDS)
    assert found.collect() == newest_unique(read_feeds(spark, folder, FEEDS), 4).collect()
    plans = found._jdf.queryExecution()
    assert plans.optimizedPlan().toString().count("MapInArrow") == 1
    assert "PartitionFilters: [concat_ws" in plans.executedPlan().toString()


def test_csv_articles(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text(
        'Headline,summary,URL,Date,Extra\n'
        '"A, ""quoted""\nline", d1 ,http://x,2024-01-01,1\n'
        ',no title,,,\n'
        '<b></b>,tags only,,bad date,2\n'
        'C,,,20240102,3\n'
    )
    rows = read_articles_csv(spark, str(path)).orderBy("row_in_split").collect()
    assert [(r.title, r.description, r.link, r.source) for r in rows] == [
        ('A, "quoted" line', "d1", "http://x", "Local CSV"),
        ("", "tags only", "", "Local CSV"),
        ("C", "", "", "Local CSV"),
    ]
    assert [str(r.published_ts) for r in rows] == [
        "2024-01-01 00:00:00", "None", "2024-01-02 00:00:00",
    ]
    assert len({r.article_id for r in rows}) == 3
    newest = csv_briefing(spark, str(path), n=2).collect()
    assert [r.title for r in newest] == ["C", 'A, "quoted" line']


def test_csv_without_title_column(spark, tmp_path):
    path = tmp_path / "b.csv"
    path.write_text("foo,bar\n1,2\n")
    with pytest.raises(ValueError, match="title"):
        read_articles_csv(spark, str(path))


def test_header_only_csv_is_empty(spark, tmp_path):
    path = tmp_path / "c.csv"
    path.write_text("title,link\n")
    assert read_articles_csv(spark, str(path)).count() == 0


def test_pick_column():
    assert pick_column(["Title", "title", "x"], ["headline", "title"]) == "title"
    assert pick_column(["TITLE"], ["title"], case_sensitive=True) is None
    assert pick_column(["News_Title", "HEADLINE"], ["headline", "news_title"]) == "HEADLINE"


def test_eval_columns_need_exact_case(spark):
    table = spark.createDataFrame([("a", "b")], "Title string, category string")
    with pytest.raises(ValueError):
        resolve_columns(table, fixed.EVAL_COLUMNS, ("text", "label"), case_sensitive=True)


def test_label_file(spark, tmp_path):
    path = tmp_path / "labels.txt"
    path.write_text("Business\n\n  Tech_news \r\nCrime")
    labels = read_labels(spark, str(path))
    assert [tuple(label) for label in labels] == [
        ("Business", "Business"), ("Tech_news", "Tech News"), ("Crime", "Crime"),
    ]
    assert label_table(spark, labels).count() == 3
    default = read_labels(spark, str(tmp_path / "absent.txt"))
    assert [label.display for label in default] == [
        "Politics", "Sports", "Tech", "Business", "Entertainment",
    ]


def test_keyword_corpus_keeps_file_order(spark, tmp_path):
    source, target = tmp_path / "in.csv", str(tmp_path / "out")
    lines = [f"{i},{'Police' if i % 2 else 'calm'} story {i}" for i in range(100)]
    source.write_text("id,headline_text\n" + "\n".join(lines) + "\n")
    write_keyword_corpus(spark, str(source), target)
    back = read_corpus(spark, target)
    assert back.columns == ["id", "headline_text"]
    assert sorted(int(r.id) for r in back.collect()) == list(range(1, 100, 2))


def test_digest_sink_and_profile(spark, tmp_path):
    digests = spark.createDataFrame([("r", "a\n\nb")], "recipient string, body string")
    write_digests(digests, str(tmp_path / "d"))
    assert spark.read.json(str(tmp_path / "d")).first()["body"] == "a\n\nb"
    assert tuple(profile(digests).first()) == (1, 2)


def test_digest_files_are_small(spark, tmp_path):
    body = F.concat_ws("\n", F.col("id"), F.repeat(F.lit("the same words again. "), 100))
    rows = spark.range(1000).select(F.concat(F.lit("r"), "id").alias("recipient"), body.alias("body"))
    write_digests(rows.coalesce(1), str(tmp_path / "d"))
    files = [path for path in (tmp_path / "d").iterdir() if path.name.startswith("part-")]
    assert sum(path.stat().st_size for path in files) < 1000 * 2200 / 10
    back = spark.read.schema(rows.schema).json(str(tmp_path / "d"))
    assert sorted(back.collect()) == sorted(rows.collect())


def test_rejects_are_counted_without_sending_texts_back(spark):
    rows = [(f"<rss><channel>{ONE_ITEM[14:-16]}<item><title>cut", 0, 1), (RSS, 1, 2)]
    docs = spark.createDataFrame(rows, "value string, feed_rank int, fetch bigint")
    narrow = scanned_entries(docs, ["position", "cut_off"])
    assert narrow.columns == ["feed_rank", "fetch", "position", "cut_off"]
    assert sorted(tuple(r) for r in narrow.collect()) == [
        tuple(r) for r in sorted(scanned_entries(docs).select(*narrow.columns).collect())
    ]
    assert [(r.fetch, r.n_entries, r.n_rejected) for r in feed_rejects(docs).orderBy("fetch").collect()] == [
        (1, 2, 1), (2, 3, 0),
    ]


def test_entries_are_sent_back_by_length():
    entries = [(place, "x" * size) for place, size in enumerate([CHARS, 5, CHARS, *[1] * (ENTRIES + 1)])]
    lists = list(_some(iter(entries)))
    assert [entry for some in lists for entry in some] == entries
    assert [len(some) for some in lists] == [1, 2, ENTRIES, 1]


def test_folders_of_many_files_are_listed_by_few_tasks(spark, tmp_path):
    setting = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    spark.conf.unset(setting)
    rows = [(ONE_ITEM, 0, fetch) for fetch in range(60)]
    docs = spark.createDataFrame(rows, "value string, feed_rank int, fetch bigint")
    docs.write.partitionBy("feed_rank", "fetch").text(str(tmp_path / "many"))
    spark.sparkContext.setJobGroup("listing", "listing")
    found = landed_feeds(spark, str(tmp_path / "many"))
    tracker = spark.sparkContext.statusTracker()
    jobs = [tracker.getJobInfo(job) for job in tracker.getJobIdsForGroup("listing")]
    tasks = [tracker.getStageInfo(stage).numTasks for job in jobs for stage in job.stageIds]
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert tasks and max(tasks) <= 4 * spark.sparkContext.defaultParallelism < 60
    assert found.count() == 60
    spark.conf.set(setting, "3")
    landed_feeds(spark, str(tmp_path / "many"))
    assert spark.conf.get(setting) == "3"
    spark.conf.unset(setting)


def test_scanner_looks_for_the_first_character_of_markup_alone():
    """A pattern whose alternatives each begin with it is tried at every character of a text."""
    text = "plain words & more " * 200_000

    def seconds(pattern):
        began = time.perf_counter()
        assert not list(pattern.finditer(text))
        return time.perf_counter() - began

    assert seconds(TOKEN) < 10 * min(seconds(re.compile("<(?:a|b)")) for _ in range(3)) + 0.05
