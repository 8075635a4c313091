"""Near-duplicate documents against all pairs of whole sets."""

import random
import re
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tidings.llm import minhash
from tidings.llm.common import table

SCHEMA = "doc_id long, text string"


def shingle_set(text, width=minhash.WORDS):
    low = "".join(chr(ord(char) + 32) if "A" <= char <= "Z" else char for char in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if 0 < len(words) < width:
        return {tuple(words)}
    return {tuple(words[place : place + width]) for place in range(len(words) - width + 1)}


def brute_force(rows):
    """(doc_id, n_shingles, component_id, kept) of every row, all pairs compared."""
    sets = [shingle_set(text) for _, text in rows]
    root = list(range(len(rows)))

    def find(place):
        while root[place] != place:
            place = root[place]
        return place

    for one in range(len(rows)):
        for other in range(one):
            shared = len(sets[one] & sets[other])
            if shared and 100 * shared >= 85 * len(sets[one] | sets[other]):
                root[find(one)] = find(other)
    least = {}
    for place, (doc_id, _) in enumerate(rows):
        key = find(place)
        if doc_id is not None:
            least[key] = min(least.get(key, doc_id), doc_id)
    return [
        (doc_id, len(sets[place]), least.get(find(place)), doc_id == least.get(find(place)))
        for place, (doc_id, _) in enumerate(rows)
    ]


def found(spark, rows):
    out = minhash.deduplicate(spark.createDataFrame(rows, SCHEMA).repartition(4))
    return [tuple(row) for row in out.collect()]


def key(row):
    return tuple((value is None, value) for value in row)


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_whole_table(spark, folder):
    docs = table(spark, f"/root/testdata/{folder}", "documents").select("doc_id", "text")
    rows = [tuple(row) for row in docs.collect()]
    out = [tuple(row) for row in minhash.deduplicate(docs).collect()]
    assert sorted(out, key=key) == sorted(brute_force(rows), key=key)


def chain(length, words=120, step=6):
    """Texts of which each is near the next one but not those further on."""
    base = [f"w{place}" for place in range(words)]
    texts = []
    for number in range(length):
        texts.append(" ".join(base))
        base[number * step % words] = f"x{number}"
    return texts


def test_chains_crowds_and_odd_rows(spark):
    rows = list(enumerate(chain(30)))
    # A crowd whose members are near the first text but hardly near each other, and strangers to it.
    base = [f"c{place}" for place in range(100)]
    for number in range(120):
        edits = [(number * 7 + place * 31) % 100 for place in range(1 + number % 6)]
        rows.append((1000 + number, " ".join(f"e{number}" if place in edits else word for place, word in enumerate(base))))
    rows += [(2000, None), (2001, ""), (2002, " \t\n"), (2003, "one two"), (2004, "ONE\x0btwo"), (2005, "one two three")]
    rows += [(None, "one two"), (None, "all alone here now"), (2006, "a\x1cb c d"), (2007, "a b c d")]
    rows += [(2008, "É b c"), (2009, "é b c"), (2010, "w " * 60_000 + "end")]
    rows += [(5, rows[5][1]), (5, "shares an id with another text entirely"), (3000, rows[40][1].upper())]
    assert sorted(found(spark, rows), key=key) == sorted(brute_force(rows), key=key)


@pytest.mark.parametrize("bounds", [{}, {"RARE": 2, "GROWTH": 3, "FEW_MET": 0}, {"RARE": 1, "FEW_MET": 10**9}])
def test_crowds_of_mostly_unlinked_texts(spark, monkeypatch, bounds):
    """Families with 0 to 30 % edits from few words: many share bands, some are linked, most are not."""
    for name, value in bounds.items():
        monkeypatch.setattr(minhash, name, value)
    rng = random.Random(8)
    rows = []
    for family in range(3):
        base = [f"f{family}w{rng.randrange(60)}" for _ in range(80)]
        for _ in range(130):
            rate = rng.choice([0.01, 0.03, 0.05, 0.08, 0.15])
            words = [f"e{rng.randrange(40)}" if rng.random() < rate else word for word in base]
            rows.append((len(rows), " ".join(words[: rng.choice([80, 80, 80, 76, 70])])))
    out = found(spark, rows)
    assert sorted(out, key=key) == sorted(brute_force(rows), key=key)
    sizes = Counter(row[2] for row in out)
    assert max(sizes.values()) > 30 and sum(size == 1 for size in sizes.values()) > 30


def test_empty_table(spark):
    assert minhash.deduplicate(spark.createDataFrame([], SCHEMA)).collect() == []


def test_no_candidates(spark):
    rows = [(1, "a b c d"), (2, "e f g h"), (3, "")]
    assert sorted(found(spark, rows)) == sorted(brute_force(rows))


def test_clashing_names(spark):
    rows = spark.createDataFrame([(1, "a b c d", 5, "x"), (2, "a b c d", 6, "y")], "doc_id long, text string, doc long, rep string")
    assert sorted(tuple(row) for row in minhash.deduplicate(rows).collect()) == [(1, 2, 1, True), (2, 2, 1, False)]


def test_columns_by_other_names(spark):
    rows = spark.createDataFrame([("b", "a b c d"), ("a", "A B C D")], "key string, body string")
    out = minhash.deduplicate(rows, "body", "key").collect()
    assert sorted(tuple(row) for row in out) == [("a", 2, "a", True), ("b", 2, "a", False)]


@settings(max_examples=200, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab é\t\n\x1f\U0001f600", max_size=20), max_size=6))
def test_sets_of_any_text(texts):
    import numpy as np

    data = [text.encode() for text in texts]
    offsets = np.cumsum([0, *map(len, data)])
    owner, hashes = minhash.shingle_sets(np.frombuffer(b"".join(data), np.uint8), offsets, 3)
    known = {}
    for place, text in enumerate(texts):
        own = set(hashes[owner == place].tolist())
        assert len(own) == (owner == place).sum() == len(shingle_set(text))
        known.setdefault(frozenset(shingle_set(text)), own)
        assert known[frozenset(shingle_set(text))] == own
    for one, first in known.items():
        for other, second in known.items():
            assert len(one & other) == len(first & second)


def test_bands_reach_the_recall():
    bands = minhash.bands_for(85, 0.999999, 5)
    assert 1 - (1 - 0.85**5) ** bands >= 0.999999
