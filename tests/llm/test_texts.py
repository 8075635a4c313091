"""Operators that look at one text at a time."""

import hashlib
import random
import re

import numpy as np
import pytest

from tidings.llm import language, pages, secrets, toxicity
from tidings.llm.common import Words, folded, held_out, letters, table

ODD = [None, "", " \n", "!!! ... 123", "x", "ß" * 3, "a b " * 20_000]


def rows_of(df, key="doc_id"):
    return {row[key]: row for row in df.collect()}


def documents(spark, texts, **extra):
    names = ["doc_id", "text", *extra]
    rows = [(place, text, *(value[place] for value in extra.values())) for place, text in enumerate(texts)]
    kinds = "doc_id long, text string" + "".join(f", {name} string" for name in extra)
    return spark.createDataFrame(rows, kinds).select(*names)


def test_words_are_those_of_the_rule():
    texts = ["Été d'hiver, l’an_2", "", "«Hé» a b—c", "x", "ÀÉ Ö×Ø"]
    coded = [text.encode() for text in texts]
    words = Words(
        folded(np.frombuffer(b"".join(coded), np.uint8)), np.cumsum([0, *map(len, coded)])
    )
    found = [
        b"".join(coded)[a:b].decode().lower() for a, b in zip(words.start, words.end, strict=True)
    ]
    assert found == ["été", "d", "hiver", "l", "an_2", "hé", "a", "b", "c", "x", "àé", "ö×ø"]
    assert words.doc.tolist() == [0] * 5 + [2] * 4 + [3] + [4] * 2
    again = Words(folded(np.frombuffer("été".encode(), np.uint8)), np.array([0, 5]))
    assert again.hash[0] == words.hash[0]


def phrases(text, known):
    """Ziv-Merhav parse by plain search, in pieces as documented."""
    count = 0
    for start in range(0, len(text), language.PIECE):
        piece, at = text[start : start + language.PIECE], 0
        while at < len(piece):
            size = 1
            while at + size < len(piece) and piece[at : at + size + 1] in known:
                size += 1
            if piece[at] not in known:
                size = 1
            count, at = count + 1, at + size
    return count


def test_cross_parse_equals_search():
    samples = (("a", "the cat sat on the mat and the dog"), ("b", "le chat est sur le tapis"))
    texts = ["the dog sat", "LE   chat, the", "zzz qqq", "x" * 700 + " the mat", "é"]
    costs, found = language.parsing_costs(texts, samples)
    for row, text in enumerate(texts):
        plain = re.sub(r"[^a-zé]+", " ", text.lower()).lstrip()
        for column, (_, known) in enumerate(samples):
            expected = phrases(plain, known) * np.log2(len(known)) / len(plain)
            assert costs[row, column] == pytest.approx(expected)
        assert found[row] == sum(char != " " for char in plain)


def test_language_edge_rows(spark):
    docs = documents(spark, ODD + ["der hund und die katze", "the dog and the cat"], score=["s"] * 9)
    samples = {"en": "the cat and the dog that is", "de": "die katze und der hund ist"}
    found = rows_of(language.identify(docs, samples))
    assert [found[place].lang_pred for place in range(4)] == ["und"] * 4
    assert (found[7].lang_pred, found[8].lang_pred) == ("de", "en")
    assert all(0 <= row.score <= 1 for row in found.values())
    none = rows_of(language.identify(docs, {}))
    assert {row.lang_pred for row in none.values()} == {"und"}
    assert language.identify(docs.limit(0), samples).count() == 0
    assert language.labelled_windows(docs.limit(0).withColumn("lang", docs.text)) == {}


def one_edit(a, b):
    """Whether two words are the same but for one edit, two letters in the wrong order being one."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    at = next((place for place, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return (
        a[at + 1 :] == b[at + 1 :] or a[at:] == b[at + 1 :] or a[at + 1 :] == b[at:]
        or (len(a) == len(b) and a[at + 2 :] == b[at + 2 :] and a[at : at + 2] == b[at : at + 2][::-1])
    )


def expected_hits(word, terms):
    """The terms a word may be taken for, and whether it is misspelled; None without any."""
    long = [term for term in terms if len(term) >= toxicity.FUZZY_LENGTH]
    good = [term for term in terms if word.startswith(term)]
    if good:
        return {max(good, key=len)}, 0
    close = {term for term in long if one_edit(word, term)}
    for size in range(1, len(word) + 1):
        begun = word[:size]
        close |= {
            term for term in long if begun[-1] == term[-1] and one_edit(begun[:-1], term[:-1])
        }
    return (close, 1) if close else None


def test_automaton_equals_edit_distance():
    random_ = random.Random(2)
    some = lambda low, high: "".join(random_.choices("abc", k=random_.randint(low, high)))
    for _ in range(15):
        terms = sorted({some(3, 7) for _ in range(6)})
        words = sorted({some(1, 10) for _ in range(400)})
        automaton = toxicity.Automaton(terms)
        word, _, _, term, kind, _ = automaton.hits(letters([" ".join(words)])[0])
        found = {int(w): (terms[t], int(k)) for w, t, k in zip(word, term, kind, strict=True)}
        for place, one in enumerate(words):
            expected = expected_hits(one, terms)
            if expected is None:
                assert place not in found, (terms, one)
            else:
                assert found[place][0] in expected[0] and found[place][1] == expected[1], (terms, one)


def test_misspellings_are_read():
    terms = ["moron", "idiot", "stupid", "clown", "scum"]
    automaton = toxicity.Automaton(terms)
    text = "moorons iddiots id1ot st*pid idoit clwn cllown stupd clonw morocco scums scm scam don't 1scum"
    word, start, end, term, kind, _ = automaton.hits(toxicity.read_letters([text])[0])
    shown = [(text[a:b], terms[t], k) for a, b, t, k in zip(start, end, term, kind.tolist(), strict=True)]
    assert shown == [
        ("moorons", "moron", 1), ("iddiots", "idiot", 1), ("id1ot", "idiot", 1), ("st*pid", "stupid", 1),
        ("idoit", "idiot", 1), ("clwn", "clown", 1), ("cllown", "clown", 1), ("stupd", "stupid", 1),
        ("clonw", "clown", 1), ("scums", "scum", 0), ("scum", "scum", 0),
    ]


def test_score_equals_plain_sums():
    """Features of a text from its words one by one, and the logistic function of their sum."""
    terms, weights = ["idiot", "moron", "baad"], np.array([[2.0, 1.0], [3.0, 2.4], [1.5, 0.0]])
    automaton = toxicity.Automaton(terms)
    text = 'You idiot, such a mooron and baad. "An idiot" he said.' + " so" * 30 + " moron"
    found = dict(zip(toxicity.FEATURES, toxicity.features([text, ""], automaton, weights)[0], strict=True))
    plain = [2.0, 2.4, 1.5, 3.0]
    words = len(re.findall(r"[A-Za-z]+", text))
    expected = {
        "plain": sum(plain), "stems": 3, "window": sum(plain[:3]), "strongest": 3.0,
        "density": 100 * sum(plain) / words, "quoted": 2.0, "size": words,
    }
    assert found == pytest.approx({name: np.log1p(value) for name, value in expected.items()})
    model = toxicity.Model(toxicity.Lexicon(()), tuple(range(1, 8)), -20.0)
    total = sum(place * found[name] for place, name in enumerate(toxicity.FEATURES, 1)) - 20
    assert toxicity._chances(np.array([list(found.values())]), model)[0] == pytest.approx(1 / (1 + np.exp(-total)))


def test_one_edit_keeps_toxic_texts_toxic(spark):
    """Held-out toxic texts of which every learnt term is misspelled by an edit in its middle."""
    folder = "/root/testdata/sf0.1"
    docs, labels = table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "labels")
    model = toxicity.learn(docs, labels)
    # Those that no clean word is spelled like.
    terms = [stem for stem, _, near in model.lexicon.weights if near > 0]
    assert {"clown", "idiot", "moron"} <= set(terms)
    bad = labels.where("toxic = 1").where(held_out("doc_id")).select("doc_id").distinct()
    rows = docs.join(bad, "doc_id").collect()
    plain = rows_of(toxicity.score(spark.createDataFrame(rows), model))
    caught = [row for row in rows if plain[row.doc_id].predicted]
    assert len(caught) >= 0.9 * len(rows) > 20
    middle = re.compile(f"(?i)\\b({'|'.join(map(re.escape, terms))})")
    for edit in (lambda w: w[:2] + "q" + w[3:], lambda w: w[:2] + w[3:], lambda w: w[:2] + w[2] + w[2:], lambda w: w[0] + w[2] + w[1] + w[3:]):
        changed = [(row.doc_id, middle.sub(lambda found, edit=edit: edit(found[0]), row.text)) for row in caught]
        found = rows_of(toxicity.score(spark.createDataFrame(changed, "doc_id long, text string"), model))
        assert sum(row.predicted for row in found.values()) >= 0.9 * len(caught)


def test_toxicity_learns_and_quotes(spark):
    bad = [f"{'so ' * (place % 9)}you zblorf w{place}" for place in range(60)]
    good = [f"{'so ' * (place % 9)}you fine w{place}" for place in range(240)]
    docs = documents(spark, bad + good)
    labels = spark.createDataFrame([(i, int(i < 60)) for i in range(300)], "doc_id long, toxic int")
    model = toxicity.learn(docs, labels)
    assert [stem for stem, *_ in model.lexicon.weights] == ["zblorf"]
    cases = documents(spark, ODD + ["you zblorf", "a zblorff here", 'he said "zblorf" to me', "fine"])
    found = rows_of(toxicity.score(cases, model))
    assert [found[place].predicted for place in (7, 10)] == [1, 0]
    assert max(found[8].score, found[9].score) < found[7].score
    assert all(0 <= found[place].score < 0.5 for place in range(7))
    kept = {row.doc_id for row in toxicity.filter_toxic(cases, model).collect()}
    assert kept == {place for place, row in found.items() if not row.predicted}


@pytest.mark.parametrize(
    ("text", "inside"),
    [
        ('"' + "so " * 60 + "zblorf" + " so" * 60 + '"', True),
        ("“" + "so " * 60 + "zblorf" + " so" * 60 + "”", True),
        ("‘I don’t " + "so " * 60 + "zblorf" + " so" * 60 + "’", True),
        ('"' + "so " * 30 + '" zblorf "so"', False),
        ('"so\nzblorf so"', False),
        ("“so” zblorf “so”", False),
        ("“so” zblorf", False),
        ("zblorf", False),
    ],
)
def test_quotations_of_any_length(text, inside):
    at = np.array([text.index("zblorf")])
    assert toxicity.quoted(text, at, at + 6).tolist() == [inside]


def test_toxicity_without_labels(spark):
    docs = documents(spark, ODD)
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    found = toxicity.score(docs, toxicity.learn(docs, empty)).collect()
    assert {row.predicted for row in found} == {0}


def test_base_spans():
    key = "AKIA" + "Q" * 12
    text = f'Token: "abcdefgh" {key} x=password=secret:abcdefghij APIKEY=short {"0f" * 16} paſſword=12345678'
    found = secrets.base_spans(text)
    shown = [(kind, text[a:b]) for kind, a, b in found]
    # "password=secret" takes "secret", so what follows the colon is no match, as it is too short.
    assert shown == [("assign", 'Token: "abcdefgh'), ("access", key), ("hex", "0f" * 16)]
    assert secrets.base_spans("é😀 token=12345678") == [("assign", 3, 17)]


def test_guess_cost_orders_values():
    costs = [secrets.guess_cost(value) for value in ("password", "aaaaaaaaaaaa", "qwertyuiop", "19840312", "x9!Kd2#qLz7")]
    assert max(costs[:4]) < 8 < secrets.LEAST_COST < costs[4]
    assert secrets.guess_cost("") == 0
    # The cheapest segmentation is no dearer than brute force.
    assert secrets.guess_cost("passwordX9") <= 10 * np.log10(62)


def test_guess_cost_reads_whole_values():
    random_ = random.Random(3)
    for count in (1, 63, 64, 65, 66, 300, 20_000):
        run = "a" * count
        assert secrets.guess_cost(run) <= np.log10(26 * max(1, count)) + 1e-9
        assert not secrets.costs_much("=" * count) and not secrets.costs_much("ab-" * count)
        # What is hard to guess may stand behind what is easy.
        assert secrets.costs_much(run + "x9!Kd2#qLz7")
    for _ in range(300):
        value = "".join(random_.choices("aab1!", k=random_.randrange(150)))
        cost = secrets.guess_cost(value)
        for enough in (2.0, 10.0, 40.0):
            assert secrets.guess_cost(value, enough) == min(cost, enough)
    assert secrets.costs_much("".join(random_.choices("qwzmfjx0185", k=1_000_000)))


def test_guessed_values_and_redaction(spark):
    texts = ODD + [
        "the pwd: x9Kd2qLz7Rt5 ok",
        "my password is monkey123 and so on",
        "password is important for everybody",
        "postgres://me:x9Kd2qLz7Rt5@host",
        "token=abcdefgh1 token=abcdefgh2",
    ]
    docs = documents(spark, texts, lang=["l"] * 12)
    found = rows_of(secrets.find_secrets(docs))
    assert [found[place].n_guess for place in range(12)] == [0] * 7 + [1, 0, 0, 1, 0]
    assert found[11].n_assign == 2 and found[11].lang == "l"
    assert found[0].base_sha256 == hashlib.sha256(b"").hexdigest() and found[0].spans == ""
    given = "assign:0:15,assign:16:31"
    assert found[11].spans == given
    assert found[11].base_sha256 == hashlib.sha256(given.encode()).hexdigest()
    shown = rows_of(secrets.redact(docs.withColumn("n", docs.doc_id), count_col="n"))
    assert shown[7].text == "the pwd: [SECRET] ok" and shown[7].n == len(shown[7].text)
    assert shown[11].text == "[SECRET] [SECRET]"
    assert [shown[place].text for place in range(7)] == ODD and shown[3].n == 3


@pytest.mark.parametrize(
    ("text", "value"),
    [
        ("secret access key: wJalrXUtnFEMI/K7MDENG", "wJalrXUtnFEMI/K7MDENG"),
        ("auth token Xy9#kLm2$Qz7", "Xy9#kLm2$Qz7"),
        ("login password k7!dLq92#xZ", "k7!dLq92#xZ"),
        ("secret password is k7!dLq92#xZ.", "k7!dLq92#xZ"),
        ("secret DB_PASS=k7!dLq92#xZ", "k7!dLq92#xZ"),
        ("AWS_SECRET_ACCESS_KEY=wJalr/K7MDENG+bPxR", "wJalr/K7MDENG+bPxR"),
        ("smtp_pwd='k7!dLq92#xZ'", "k7!dLq92#xZ"),
        ("DB_PASSWORD=p@ss!W0rd#2024x", "p@ss!W0rd#2024x"),
        ("SECRET_KEY_BASE=k7!dLq92#xZ smtpPass: x", "k7!dLq92#xZ"),
        ('{"dbPass": "k7!dLq92#xZ"}', "k7!dLq92#xZ"),
        ("Authorization: Bearer k7!dLq92#xZ", "k7!dLq92#xZ"),
        ("token: postgres://me:k7!dLq92#xZ@host", "k7!dLq92#xZ"),
    ],
)
def test_contexts_do_not_hide_each_other(text, value):
    found = secrets.guessed_spans(text, secrets.base_spans(text))
    assert [text[a:b] for _, a, b in found] == [value]


def test_contexts_of_long_names_take_linear_time():
    for part in ("pass_", "pass:", "pwd=", "apwd:", "pass "):
        assert len(secrets.context_values(part * 100_000)) <= 100_000
    assert not secrets.guessed_spans("an author: Someone-Else2 bypass x9!Kd2#qLz7", [])


PAGE = """<html><head><title>No</title><style>p{}</style><script>var a="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></nav>
<div class="sidebar">Some words that stand at the side of the page for long enough to look like text.</div>
<div class="cookie-notice">We use cookies and many other things that nobody wants to read at all.</div>
<article><header><h1>Title &amp; more</h1></header><p>One  two<br>three <b>four</b> five.<p>Short.
<aside>By the way, this is not part of it at all, is it.</aside><p>Last &lt;one&gt; &eacute;</p>
<form><p>Write to us now</p></form></article>
<section id="comments"><p>I am a reader and I write a long comment about this text, as you see.</p></section>
<footer>&copy; us</footer>"""


@pytest.fixture(scope="module")
def tree(spark):
    return pages.train(spark)


def test_page_text(spark, tree):
    plain = "<body><div><a href=x>Home</a></div><div>" + "many plain words stand here " * 9 + "</div>"
    htmls = [PAGE, None, "", "<p>", plain, "just text, " * 30, "<article>" + "<p>a</p>" * 5000]
    rows = [(place, html, "u", place) for place, html in enumerate(htmls)]
    given = spark.createDataFrame(rows, "page_id long, html string, url string, n_chars long")
    found = rows_of(pages.extract(given, tree, keep=["page_id", "url"]), "page_id")
    assert found[0].text == "Title & more\n\nOne two three four five.\n\nShort.\n\nLast <one> é"
    assert [found[place].text for place in (1, 2, 3)] == ["", "", ""]
    assert found[4].text == ("many plain words stand here " * 9).strip()
    assert found[5].text == ("just text, " * 30).strip()
    assert found[6].text == "\n\n".join(["a"] * 5000)
    assert all(row.n_chars == len(row.text) for row in found.values())
    assert pages.extract(given.limit(0), tree).count() == 0


STORY = "many plain words stand here " * 9


@pytest.mark.parametrize(
    "before",
    [
        "<nav><ul>" + "<li><a href=x>Home</a>" * 200 + "</ul></nav>",
        "<select>" + "<option>Country" * 200 + "</select>",
        "<nav><table>" + "<tr><td>a<td><a href=x>b</a>" * 200 + "</table></nav>",
        "<nav><dl>" + "<dt>a<dd>b" * 200 + "</dl></nav>",
        "<nav>" + "<span>" * 200 + "</nav>",
        '<div class="content has-sidebar">',
        '<div class="post no-comments">',
        '<div id="layout--sidebar-left" class="content_with_menu">',
        "<head><title>No</title><body>",
    ],
)
def test_text_behind_the_frame_stays(spark, tree, before):
    given = spark.createDataFrame([(0, f"{before}<p>{STORY}</p>")], "page_id long, html string")
    assert pages.extract(given, tree).first().text == STORY.strip()


def test_implied_ends_keep_to_their_list():
    parser = pages.Blocks()
    parser.feed("<ul><li>a<ul><li>b<li>c</ul><li>d<p>e<table><tr><td>f<table><tr><td>g</table>h<td>i")
    assert [name for name, *_ in parser.open] == ["ul", "li", "table", "tr", "td"]
    assert all(pages.frame_words(name) for name in ("x Side-Bar", "site_header", "cookie-notice", "nav--open", "widget2"))
    assert not any(pages.frame_words(name) for name in ("is-menu-open", "download", "headers", "grid--sidebar"))


def test_tree_knows_its_table(spark, tree):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([tuple(map(float, row)) for row in pages.LABELLED], [*pages.FEATURES, "label"])
    block = F.struct(*pages.FEATURES)
    found = rows.select((pages.as_condition(tree, block)).cast("double").alias("p"), "label").collect()
    assert sum(row.p == row.label for row in found) >= 0.95 * len(found)


WRAPPERS = [
    "post category-legal", "post tag-comments", "container right-sidebar", "wrapper header-fixed", "content-menu-push",
    "story social-justice", "news-alert-story", "entry share-buttons-on",
]


@pytest.mark.parametrize("heading", ["h1", "h2"])
@pytest.mark.parametrize("names", WRAPPERS)
def test_names_of_what_holds_the_article_do_not_tell(names, heading):
    """An element with most of a page's words is no frame, whatever its class says; small ones are."""
    said = [" ".join(f"{word}{place}" for place in range(size)) for word, size in (("one", 60), ("two", 45), ("nice", 30), ("side", 20))]
    html = (
        f"<nav><a href=/>Home</a></nav><div class='{names}'><{heading}>Head line</{heading}><p>{said[0]}</p><p>{said[1]}</p></div>"
        f"<div class='comments'><p>{said[2]}</p></div><div class='right-sidebar'><p>{said[3]}</p></div>"
    )
    places = {text.split()[0]: place for text, *_, place, _ in pages.page_blocks(html)}
    assert places == {"Home": 0, "Head": 1, "one0": 1, "two0": 1, "nice0": 0, "side0": 0}


def test_readers_may_say_more_than_the_article():
    html = f"<article><p>{'word ' * 30}</p></article><section id='comments'>{'<p>' + 'I think so too. ' * 10 + '</p>'}</section>"
    html += f"<div class='comment-list'>{'<p>' + 'more of it ' * 200 + '</p>'}</div>"
    assert [block[-2] for block in pages.page_blocks(html)] == [2, 0, 0]
