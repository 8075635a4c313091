"""Results depend on these exact words, formats and limits."""

from __future__ import annotations

# Feed catalog. Order matters, the earlier feed wins a duplicate.
FEEDS = [
    ("The Hindu - National", "https://www.thehindu.com/news/national/feeder/default.rss"),
    ("The Hindu - Sport", "https://www.thehindu.com/sport/feeder/default.rss"),
    ("The Hindu - Tech", "https://www.thehindu.com/sci-tech/technology/feeder/default.rss"),
    ("The Hindu - Entertainment", "https://www.thehindu.com/entertainment/feeder/default.rss"),
    ("NDTV - Top Stories", "https://feeds.feedburner.com/ndtvnews-top-stories"),
    ("NDTV - Sports", "https://feeds.feedburner.com/ndtvsports-latest"),
    ("NDTV - Tech", "https://feeds.feedburner.com/gadgets360-latest"),
    ("NDTV - Entertainment", "https://feeds.feedburner.com/ndtvmovies-latest"),
    ("Indian Express - India", "https://indianexpress.com/section/india/feed/"),
    ("Indian Express - Sports", "https://indianexpress.com/section/sports/feed/"),
    ("Indian Express - Tech", "https://indianexpress.com/section/technology/feed/"),
    ("Indian Express - Entertainment", "https://indianexpress.com/section/entertainment/feed/"),
]

# Labels used when there is no label file, with their display names.
DEFAULT_LABELS = [
    ("Politics", "Politics"),
    ("Sports", "Sports"),
    ("Technology", "Tech"),
    ("Business", "Business"),
    ("Entertainment", "Entertainment"),
]

# Classes kept for the balanced corpus, sample size and seed.
BALANCED_CLASSES = [
    "Business", "Crime", "Entertainment", "Politics", "Sports", "Technology", "Finance",
]
SAMPLE_PER_CLASS = 1000
SAMPLE_SEED = 42

# Hypothesis templates; ids ending in "_expanded" use the phrases below.
ARTICLE_TEMPLATE = "This news article is about {}."
TEMPLATES = [
    ("P0_baseline_article", "This news article is about {}."),
    ("P1_baseline_indian", "The primary topic of this Indian headline is {}."),
    ("P2_baseline_headline", "This headline is about {}."),
    ("P3_covers", "This Indian news headline covers {}."),
    ("P4_category", "This headline belongs to the {} category."),
    ("P5_reports_on", "This Indian headline reports on {}."),
    ("P6_section", "This article is filed under the {} section."),
    ("P7_focuses", "This Indian news headline focuses on {}."),
    ("P8_subject_expanded", "The subject of this Indian headline is {}."),
    ("P9_specific_expanded", "This Indian news headline focuses on the topic of {}."),
]
EXPANDED_SUFFIX = "_expanded"
EXPANDED_PHRASES = {
    "Politics": "politics and government",
    "Sports": "sports and games",
    "Technology": "science and technology",
    "Business": "business and economy",
    "Entertainment": "entertainment and cinema",
    "Crime": "crime and law",
    "Science": "science and research",
    "Finance": "finance and banking",
}

# Crime keywords, matched anywhere in the text, ignoring case.
KEYWORD_LIMIT = 5000
CRIME_KEYWORDS = [
    "crime", "criminal", "murder", "homicide", "manslaughter", "assault", "stabbing",
    "shooting", "kidnapping", "abduction", "rape", "domestic violence",
    "robbery", "theft", "burglary", "heist", "arson", "vandalism", "looting", "fraud",
    "embezzlement", "bribery", "extortion", "blackmail", "scam", "money laundering",
    "corruption",
    "smuggling", "trafficking", "cartel", "gang", "mafia", "narcotics",
    "arrest", "arrested", "suspect", "police", "cops", "detective", "sheriff",
    "investigation", "raid", "warrant", "manhunt", "fugitive", "apprehended",
    "indicted", "indictment", "charged", "court", "trial", "lawsuit", "verdict", "guilty",
    "acquitted", "sentenced", "prison", "jail", "inmate", "prosecutor", "plea", "bail",
    "parole",
    "felony", "misdemeanor", "illegal", "illicit", "offense", "violation",
]

# Column names accepted for each field, best first.
ARTICLE_COLUMNS = {
    "title": ["title", "headline", "headline_text", "news_title", "article_title"],
    "description": ["description", "summary", "text", "details", "content", "article"],
    "link": ["link", "url", "article_url", "news_url"],
    "published": [
        "published", "date", "datetime", "timestamp", "time", "published_at", "updated_at",
    ],
    "source": ["source", "publisher", "news_source", "outlet"],
}
EVAL_COLUMNS = {
    "text": ["headline_text", "title", "headline", "news_title"],
    "label": ["category", "headline_category", "section", "topic"],
}

# Texts shown when something is missing.
UNTITLED = "Untitled"
UNKNOWN = "Unknown"
CSV_SOURCE = "Local CSV"
NO_SUMMARY = "Summary unavailable."
PAD_LINE = "Additional details are awaited."

# Lines of a digest and of an article card.
GREETING = "Hi {},"
OPENING = "Here are your top updates today:"
CLOSING = "Regards,"
DIGEST_DATE = "dd MMM yyyy"
LINE_INDENT = "   "
CARD_HEADING = "### [%s](%s)"
CARD_CAPTION = "Source: %s | Published: %s | Zero-shot confidence: %.2f"
NO_DATE = "N/A"

# Place of the text in a provider's reply.
CONTENT_PATH = "$.choices[0].message.content"

# Summary shape, digest size, triage threshold, request limits.
SUMMARY_LINES = 3
SUMMARY_WORDS = 22
NEWEST = 30
LOW_CONFIDENCE = 0.45
REQUESTS_PER_MINUTE = 10
REQUESTS_PER_DAY = 1000

# Words that mark a reply as refused for rate or quota.
TOO_MANY_REQUESTS = 429
RATE_LIMIT_TOKENS = ["429", "rate limit", "resource exhausted", "too many requests", "quota"]

# Prompt texts sent with a batch of articles and with a single article.
BATCH_PROMPT = (
    "For each item, summarize the news article in exactly 3 concise lines in plain text, "
    "no bullets, no numbering. Each line should be <= 22 words and fact-focused. "
    "Return ONLY a JSON array of objects with keys 'id' and 'summary'. "
    "The 'summary' value must be a single string with line breaks as \\n separators. "
    "Keep the same order and ids.\n\n"
    "Items: "
)
SINGLE_PROMPT = (
    "Write exactly 3 concise lines in plain text, no bullets, no numbering. "
    "Each line should be <= 22 words and fact-focused.\n\n"
)
TITLE_FIELD = "Title: "
DETAILS_FIELD = "\nDetails: "

# White space of Unicode text, as characters and as a pattern, and line boundaries.
SPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
SPACE = (
    r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
LINE_BREAK = r"\r\n|[\n\x0b\x0c\r\x1c-\x1e\x{85}\x{2028}\x{2029}]"
