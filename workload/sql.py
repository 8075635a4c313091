"""Pieces of DuckDB SQL shared by the checks."""

from __future__ import annotations

from tidings import fixed_values as fixed
from workload import views as V

SPACE = fixed.SPACE


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^{SPACE}+|{SPACE}+\z', '', 'g')"


def decode(x: str) -> str:
    """The entities that occur in the tables; the ampersand goes last."""
    for name, char in (("quot", "'\"'"), ("middot", "chr(183)"), ("copy", "chr(169)")):
        x = f"regexp_replace({x}, '&{name};?', {char}, 'g')"
    return f"regexp_replace({x}, '&amp;?', '&', 'g')"


def clean(x: str) -> str:
    untagged = f"regexp_replace({decode(f'coalesce({x}, \'\')')}, '<[^>]+>', ' ', 'g')"
    return f"trim(regexp_replace({untagged}, '{SPACE}+', ' ', 'g'))"


def clean_summary(x: str) -> str:
    x = f"regexp_replace({decode(x)}, '<[^>]+>', ' ', 'g')"
    x = rf"regexp_replace({x}, '\r\n?', chr(10), 'g')"
    x = rf"regexp_replace({x}, '[ \t]+', ' ', 'g')"
    x = rf"regexp_replace({x}, '\n{{3,}}', chr(10) || chr(10), 'g')"
    x = rf"regexp_replace({x}, '\n[ \t]+', chr(10), 'g')"
    return strip(x)


def split_sentences(x: str) -> str:
    marked = rf"regexp_replace({x}, '([.!?]){SPACE}+', '\1' || chr(1), 'g')"
    pieces = f"string_split({marked}, chr(1))"
    return f"list_filter(list_transform({pieces}, lambda s: {strip('s')}), lambda s: s <> '')"


def fallback(x: str) -> str:
    pad = "'" + fixed.PAD_LINE + "'"
    lines = f"list_concat({split_sentences(strip(x))}, [{pad}, {pad}, {pad}])[1:3]"
    return (
        f"CASE WHEN {strip(x)} = '' THEN '{fixed.NO_SUMMARY}' "
        f"ELSE array_to_string({lines}, chr(10)) END"
    )


def tokens(x: str) -> str:
    return (
        rf"list_filter(regexp_split_to_array(lower({x}), '[^\p{{L}}\p{{N}}]+'), "
        "lambda t: t <> '')"
    )


DETAILS = "coalesce(nullif(description, ''), title, '')"
PREMISE = strip("title || '. ' || coalesce(description, '')")
RECENCY = "published_ts DESC NULLS LAST, feed_rank, entry_index"

ARTICLES = """
arts AS (
  SELECT 'd' || d.doc_id AS article_id, d.source, CAST(substr(d.source, 4) AS INTEGER) AS feed_rank,
         d.doc_id AS entry_index, split_part(d.text, chr(10), 1) AS title,
         coalesce(p.url, '') AS link,
         substr(d.text, length(split_part(d.text, chr(10), 1)) + 2) AS description,
         coalesce(strftime(e.ts, '%Y-%m-%dT%H:%M:%S'), '') AS published,
         date_trunc('hour', e.ts) AS published_ts, d.lang
  FROM documents d
  LEFT JOIN pages p ON p.page_id = d.doc_id
  LEFT JOIN events e ON e.event_id = d.doc_id AND e.event_type <> 'error'
)"""

UNIQUE = """
uniq AS (
  SELECT * FROM arts WHERE coalesce(nullif(link, ''), title) <> ''
  QUALIFY row_number() OVER (
    PARTITION BY coalesce(nullif(link, ''), title) ORDER BY feed_rank, entry_index) = 1
)"""


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def values(rows: list[tuple]) -> str:
    def cell(value) -> str:
        return quoted(value) if isinstance(value, str) else str(value)

    return "VALUES " + ", ".join("(" + ", ".join(map(cell, row)) + ")" for row in rows)


def label_values(labels=None) -> str:
    rows = [(i, *label) for i, label in enumerate(V.LABELS if labels is None else labels)]
    return f"(SELECT * FROM ({values(rows)}) t(label_rank, label, display))"


def scored(texts: str, labels, templates: list[tuple[str, str]], name: str = "scored") -> str:
    """CTEs: every (article_id, prompt_id, label) of ``texts(article_id, x)`` with its logit,
    probability and rank. ``labels`` is rows of (prompt_id, rank, label, phrase)."""
    hyps = [
        (pid, rank, label, template.replace("{}", phrase))
        for pid, template in templates
        for (lp, rank, label, phrase) in labels
        if lp == pid
    ]
    return f"""
hyps AS (
  SELECT prompt_id, label_rank, label, list_distinct({tokens('hypothesis')}) AS words
  FROM ({values(hyps)}) t(prompt_id, label_rank, label, hypothesis)
),
toks AS (SELECT article_id, list_distinct({tokens('x')}) AS words FROM {texts}),
logits AS (
  SELECT t.article_id, h.prompt_id, h.label_rank, h.label,
         len(list_intersect(h.words, t.words))::DOUBLE / len(h.words) * 10.0 AS logit
  FROM toks t, hyps h
),
expd AS (
  SELECT *, exp(logit - max(logit) OVER (PARTITION BY article_id, prompt_id)) AS ex FROM logits
),
{name} AS (
  SELECT *, ex / sum(ex) OVER (PARTITION BY article_id, prompt_id) AS p,
         row_number() OVER (PARTITION BY article_id, prompt_id
                            ORDER BY logit DESC, label_rank) AS rn
  FROM expd
)"""


def one_template(labels, template: str) -> tuple[list, list]:
    return [("t", i, label.label, label.label) for i, label in enumerate(labels)], [("t", template)]


TAGGED = f"""
{ARTICLES},
texts AS (SELECT article_id, {PREMISE} AS x FROM arts),
{scored('texts', *one_template(V.PHRASED, V.TEMPLATE))},
display AS (SELECT label, display FROM {label_values(V.PHRASED)}),
tagged AS (
  SELECT a.*, s.label AS raw_category, d.display AS category, s.p AS confidence
  FROM arts a JOIN scored s ON s.article_id = a.article_id AND s.rn = 1
  JOIN display d ON d.label = s.label
)"""

PAIRS = f"""
pairs AS (
  SELECT doc_id AS article_id, {strip('text')} AS x, {strip('lang')} AS y FROM documents
  WHERE text IS NOT NULL AND lang IS NOT NULL AND {strip('text')} <> ''
    AND {strip('lang')} IN ('en', 'fr', 'es', 'de')
)"""

PREDS = f"""
{PAIRS},
{scored('pairs', *one_template(V.LABELS, V.TEMPLATE))},
preds AS (
  SELECT p.article_id, p.y, s.label AS yhat, s.p AS confidence
  FROM pairs p JOIN scored s ON s.article_id = p.article_id AND s.rn = 1
)"""

SEGMENTS = values([(k, "|".join(sorted(v))) for k, v in V.SEGMENT_CATEGORIES.items()])
RECIPIENTS = f"""
recipients AS (
  SELECT c_name AS recipient, string_split(s.names, '|') AS categories,
         c_nationkey + 5 AS max_articles
  FROM customer JOIN ({SEGMENTS}) s(segment, names) ON s.segment = c_mktsegment
)"""

MATCHED = f"""
{TAGGED},
{RECIPIENTS},
wanted AS (SELECT recipient, max_articles, unnest(categories) AS category FROM recipients),
tops AS (
  SELECT article_id, category, published_ts, feed_rank, entry_index FROM tagged
  QUALIFY row_number() OVER (PARTITION BY category ORDER BY {RECENCY})
    <= (SELECT max(max_articles) FROM recipients)
),
matched AS (
  SELECT w.recipient, w.max_articles, t.article_id,
         row_number() OVER (PARTITION BY w.recipient
                            ORDER BY t.published_ts DESC NULLS LAST, t.feed_rank, t.entry_index)
           AS number
  FROM wanted w JOIN tops t ON t.category = w.category
  QUALIFY number <= w.max_articles
)"""

CLASS_COUNTS = f"""
{PREDS},
names AS (SELECT y AS label FROM preds UNION SELECT yhat FROM preds),
counts AS (
  SELECT n.label, (SELECT count(*) FROM preds WHERE y = n.label AND yhat = n.label) AS hits,
         (SELECT count(*) FROM preds WHERE yhat = n.label) AS predicted,
         (SELECT count(*) FROM preds WHERE y = n.label) AS support
  FROM names n
),
report AS (
  SELECT label, CASE WHEN predicted = 0 THEN 0.0 ELSE hits / predicted END AS precision,
         CASE WHEN support = 0 THEN 0.0 ELSE hits / support END AS recall,
         CASE WHEN predicted + support = 0 THEN 0.0 ELSE 2 * hits / (predicted + support) END AS f1,
         support, hits
  FROM counts
)"""

PLACED = f"""
placed AS (
  SELECT *, (row_number() OVER (ORDER BY {RECENCY}) - 1) // {V.BATCH} AS batch,
         (row_number() OVER (ORDER BY {RECENCY}) - 1) % {V.BATCH} + 1 AS id
  FROM arts
)"""
