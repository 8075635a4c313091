"""Operators that compare texts with each other, against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidings import session
from tidings.llm import graph, imatch, leaks, near, spans
from tidings.llm.graph import components

SCHEMA = "doc_id long, text string"
WORD = re.compile(r"\w+")


def prose(random_, size, words=4000):
    return " ".join(f"w{random_.randrange(words)}" for _ in range(size))


def corpus(seed=5):
    """Texts with exact and near copies, chains of edits, short, empty and null texts."""
    random_ = random.Random(seed)
    texts = [prose(random_, random_.randrange(1, 120)) for _ in range(80)]
    texts += texts[:10] * 2
    chain = prose(random_, 100).split()
    for _ in range(60):
        chain = list(chain)
        chain[random_.randrange(100)] = f"x{random_.random()}"
        texts.append(" ".join(chain))
    texts += ["one two three", "One, two: three!", "one two", "", None, "...", "", None, "a", "a"]
    return list(enumerate(texts))


def ngrams(text):
    words = WORD.findall((text or "").lower())
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def brute_links(rows):
    sets = {key: ngrams(text) for key, text in rows}
    links = defaultdict(set)
    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a != b and both and both >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
                links[a].add(b)
    return links


@pytest.mark.parametrize(("tile", "ngrams"), [(256, 1 << 22), (7, 1 << 22), (256, 300)])
def test_near_duplicates_equal_brute_force(spark, tile, ngrams):
    rows = corpus()
    links = brute_links(rows)
    docs = spark.createDataFrame(rows, SCHEMA)
    found = near.near_duplicates(docs, tile=tile, tile_ngrams=ngrams).collect()
    assert {row.doc_id: row.n_links for row in found} == {key: len(links[key]) for key, _ in rows}
    seen = {}
    for key, _ in rows:
        todo, group = [key], {key}
        while todo:
            new = links[todo.pop()] - group
            group |= new
            todo += new
        seen[key] = min(group)
    assert {row.doc_id: row.class_id for row in found} == seen


def test_one_of_each_class_stays(spark):
    rows = [(1, "a b c d e f"), (2, "A b, c d e f"), (3, "other words"), (3, "other words"), (None, "a b c d e f"), (4, None)]
    docs = spark.createDataFrame([(*row, "x") for row in rows], SCHEMA + ", leader string")
    kept = near.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((row.doc_id or 0) for row in kept.collect()) == [0, 1, 3, 4]
    assert near.near_duplicates(docs.limit(0)).count() == 0


def test_rows_that_share_a_doc_id_are_told_apart(spark):
    random_ = random.Random(21)
    texts = [prose(random_, 40) for _ in range(4)]
    rows = [(1, texts[0]), (1, texts[1]), (2, texts[0]), (3, texts[2]), (3, texts[0]), (4, texts[2]), (None, texts[3])]
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = sorted((row.doc_id or 0, row.text) for row in near.keep_one(docs).collect())
    assert kept == sorted([(1, texts[0]), (1, texts[1]), (3, texts[2]), (0, texts[3])])
    bench = spark.createDataFrame([(1, texts[0]), (2, texts[3])], "item_id long, text string")
    kept = sorted((row.doc_id, row.text) for row in leaks.drop_leaks(docs, bench).collect())
    assert kept == sorted([(1, texts[1]), (3, texts[2]), (4, texts[2])])


def test_bands_reach_the_recall():
    bands = near.bands_for(0.8, 0.9999, 5)
    assert 1 - (1 - 0.8**5) ** bands >= 0.9999 > 1 - (1 - 0.8**5) ** (bands - 1)


def test_components(spark):
    random_ = random.Random(3)
    edges = [(random_.randrange(300), random_.randrange(300)) for _ in range(200)]
    edges += [(1000 + k, 1001 + k) for k in range(40)] + [(5, 5)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    found = components(spark.createDataFrame(edges, "a long, b long"))
    assert dict(map(tuple, found.collect())) == {x: find(x) for x in root if find(x) != x}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def least_of_each(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {x: find(x) for x in root if find(x) != x}


@pytest.mark.parametrize("few", [graph.FEW_KNOTS, -1])
def test_components_shuffle_edges_once(spark, monkeypatch, few):
    """Of a crowd, of copies of edges and of nodes between two; with and without broadcasts."""
    shuffles = []

    def counted(df, name):
        plan = df._jdf.queryExecution().executedPlan().toString()
        shuffles.append(plan.split("InMemoryRelation")[0].count("Exchange hashpartitioning"))
        return session.pin(df, name)

    monkeypatch.setattr(graph, "pin", counted)
    monkeypatch.setattr(graph, "FEW_KNOTS", few)
    random_ = random.Random(4)
    edges = [(random_.randrange(400), 400 + random_.randrange(200)) for _ in range(500)] * 2
    edges += [(999, 1000 + k) for k in range(50)] + [(1000 + k, 2000) for k in range(50)] + [(7, None)]
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = [tuple(row) for row in components(spark.createDataFrame(edges, "a long, b long")).collect()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert sorted(found) == sorted(least_of_each(edge for edge in edges if None not in edge).items())
    # Steps shuffle no edges while knots are few; many are written for a plain join of two sides.
    assert shuffles[0] == 1
    assert set(shuffles[1:]) == ({0} if few > 0 else {0, 2})


def test_stars_are_seen_to_be_stars(spark, monkeypatch):
    """Neither stars nor what a step makes stars take another step to find out."""
    written = []
    monkeypatch.setattr(graph, "pin", lambda df, name: written.append(name) or session.pin(df, name))
    stars = [(1, 5), (1, 9), (3, 8), (3, 8), (4, 4)]
    assert sorted(map(tuple, components(spark.createDataFrame(stars, "a long, b long")).collect())) == [(5, 1), (8, 3), (9, 1)]
    assert written == ["edges"]
    written.clear()
    found = components(spark.createDataFrame([(1, 5), (2, 5)], "a long, b long"))
    assert sorted(map(tuple, found.collect())) == [(2, 1), (5, 1)]
    assert written == ["edges", "edges"]


def test_leaks(spark):
    random_ = random.Random(9)
    items = [prose(random_, size) for size in (40, 30, 20, 8, 3)] + [None, "", "!!"]
    swapped = items[0].split()
    for place in range(3, 40, 7):
        swapped[place] = "other"
    texts = {
        1: prose(random_, 50) + " " + items[0] + " " + prose(random_, 50),
        2: prose(random_, 20) + " " + " ".join(swapped) + " " + prose(random_, 20),
        3: prose(random_, 200),
        4: "start " + items[3].upper() + "! end",
        5: prose(random_, 9) + " " + items[4] + ".",
        6: prose(random_, 30) + " " + " ".join(items[1].split()[:6]) + " " + prose(random_, 30),
        7: None,
        8: "",
        9: items[2] + " " + prose(random_, 5000) + " " + items[1],
    }
    docs = spark.createDataFrame([(*pair, "x") for pair in texts.items()], SCHEMA + ", leaked string")
    bench = spark.createDataFrame(
        list(enumerate(items)) + [(77, items[0])], "item_id long, text string"
    )
    found = leaks.find_leaks(docs, bench).collect()
    pairs = {(row.doc_id, row.item_id): row for row in found}
    assert set(pairs) == {(1, 0), (2, 0), (4, 3), (5, 4), (9, 1), (9, 2)}
    assert pairs[1, 0].matched == 40 and pairs[1, 0].start == 50 and pairs[1, 0].item_copies == 2
    assert pairs[2, 0].matched == 34 and pairs[2, 0].words == 40
    kept = leaks.drop_leaks(docs, bench)
    assert kept.columns == docs.columns
    assert {row.doc_id for row in kept.collect()} == {3, 6, 7, 8}
    assert leaks.find_leaks(docs, bench.limit(0)).count() == 0
    assert leaks.find_leaks(docs.limit(0), bench).count() == 0


def test_longest_span_equals_search():
    random_ = np.random.default_rng(1)
    for _ in range(200):
        equal = random_.random(random_.integers(1, 30)) < 0.7
        best = max(
            (b - a for a in range(len(equal)) for b in range(a + 1, len(equal) + 1) if equal[a:b].mean() >= 0.8 - 1e-12),
            default=0,
        )
        start, end = leaks.longest_span(equal, 0.8)
        assert end - start == best


def brute_cut(rows, sentences, words):
    """Kept text of each row, sentence by sentence, for texts without long sentences."""
    cut = {key: re.findall(r"[^.!?\n]*[.!?\n]+\s*|[^.!?\n]+$", text) for key, text in rows}
    norm = {key: [tuple(WORD.findall(one.lower())) for one in parts] for key, parts in cut.items()}
    runs = defaultdict(list)
    for key, parts in norm.items():
        for start in range(len(parts)):
            end = start + sentences
            while end <= len(parts) and sum(map(len, parts[start:end])) < words:
                end += 1
            if end <= len(parts):
                flat = tuple(word for one in parts[start:end] for word in one)
                runs[flat, end - start].append((key, start, end))
    gone = set()
    for places in runs.values():
        for key, start, end in sorted(places)[1:]:
            gone |= {(key, place) for place in range(start, end)}
    return {
        key: "".join(one for place, one in enumerate(parts) if (key, place) not in gone)
        for key, parts in cut.items()
    }


def test_repeated_spans_equal_brute_force(spark):
    random_ = random.Random(4)
    pool = [" ".join(f"w{random_.randrange(40)}" for _ in range(random_.randrange(1, 9))) + ". " for _ in range(40)]
    rows = [
        (key, "".join(random_.choice(pool) for _ in range(random_.randrange(1, 6))) + "".join(pool[at : at + 6]) + f"End {key}.")
        for key in range(30)
        for at in [random_.randrange(36)]
    ]
    rows += [(100, rows[0][1]), (101, "É a. " * 9)]
    expected = brute_cut(rows, 3, 10)
    docs = spark.createDataFrame([*rows, (102, None), (103, ""), (104, "..")], SCHEMA)
    found = {row.doc_id: row for row in spans.cut_repeats(docs, words=10).collect()}
    assert {key: found[key].text for key in expected} == expected
    assert [found[key].text for key in (102, 103, 104)] == [None, "", ".."]
    given = dict(rows)
    for key in expected:
        left, at = "", 0
        for span in found[key].spans:
            left, at = left + given[key][at : span.start], span.end
        assert left + given[key][at:] == found[key].text
    assert found[100].text == "" and found[0].n_removed < found[0].n_sentences
    assert spans.cut_repeats(docs.limit(0)).count() == 0


def test_long_passage_without_stops_is_found(spark):
    random_ = random.Random(8)
    passage = prose(random_, 70)
    rows = [(key, prose(random_, 30 + key) + " " + passage + " " + prose(random_, 40)) for key in range(3)]
    rows += [(9, prose(random_, 300)), (9, prose(random_, 300))]
    found = spans.cut_repeats(spark.createDataFrame(rows, SCHEMA)).collect()
    middle = " ".join(passage.split()[25:45])
    assert [middle in row.text for row in sorted(found, key=lambda row: row.doc_id)] == [True, False, False, False, False]
    assert [row.n_removed for row in found if row.doc_id == 9] == [0, 0]


def test_every_passage_of_over_50_words_is_found(spark):
    random_ = random.Random(12)
    passages = [" ".join(f"w{word}" for word in random_.sample(range(4000), 51)) for _ in range(300)]
    rows = [
        (2 * key + copy, f"{prose(random_, random_.randrange(5, 40))} {passage} {prose(random_, random_.randrange(5, 40))}")
        for key, passage in enumerate(passages)
        for copy in (0, 1)
    ]
    found = {row.doc_id: row for row in spans.cut_repeats(spark.createDataFrame(rows, SCHEMA)).collect()}
    for key, passage in enumerate(passages):
        assert found[2 * key].n_removed == 0
        own = rows[2 * key + 1][1].replace(passage, "").split()
        middle = set(passage.split()[2 * spans.WINDOW : -3 * spans.WINDOW]) - set(own)
        assert middle and not middle & set(found[2 * key + 1].text.split())


def test_fingerprints(spark):
    random_ = random.Random(2)
    texts = [prose(random_, random_.randrange(0, 300), 300) for _ in range(60)] + ["", None, "é" * 7, "x"]
    texts += texts[:2]
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    lexicon = imatch.learn_lexicon(docs, least=0.1, most=0.5)
    total = Counter(word for text in texts for word in set(WORD.findall((text or "").lower())))
    assert len(lexicon) == sum(0.1 * len(texts) <= n <= 0.5 * len(texts) for n in total.values())
    found = {row.doc_id: row for row in imatch.compare_edited(docs, lexicon).collect()}
    assert len(found) == len(texts)
    keys = sorted(found, reverse=True)
    for key, following in zip(keys, keys[1:] + keys[:1], strict=True):
        text, other = texts[key] or "", texts[following] or ""
        third = len(text) // 3
        edited = text[: len(text) - third] + other[:third]
        row = found[key]
        assert row.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert row.n_chars == len(text)
        single = imatch.fingerprints(*imatch._as_bytes([text, edited, other]), lexicon)
        assert [one.tobytes().hex() for one in single[:2]] == [row.fingerprint, row.edited_fingerprint]
        assert row.near_next == imatch.likeness(single[:1], single[2:])[0]
    assert found[0].fingerprint == found[64].fingerprint
    plain = {row.doc_id: row.fingerprint for row in imatch.fingerprint(docs, lexicon).collect()}
    assert plain == {key: row.fingerprint for key, row in found.items()}


def test_fingerprints_of_odd_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert imatch.compare_edited(none, imatch.learn_lexicon(none)).count() == 0
    one = spark.createDataFrame([(5, "abc def")], SCHEMA)
    row = imatch.compare_edited(one, imatch.learn_lexicon(one)).first()
    assert row.near_next == 1.0 and row.n_chars == 7
    rows = [(1, "a b"), (1, "a b"), (None, "c"), (None, "d")]
    many = spark.createDataFrame(rows, SCHEMA)
    assert imatch.compare_edited(many, imatch.learn_lexicon(many)).count() == 4
