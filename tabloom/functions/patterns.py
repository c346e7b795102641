"""Regular expressions, word lists and keyword tables the results depend on."""

# fixed values: patterns for e-mail, phone and date texts, with explicit word-edge classes
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}"
PHONE = r"(^|[^\p{L}\p{N}_])\d{3}[-.]?\d{3}[-.]?\d{4}([^\p{L}\p{N}_]|$)"
DATE = r"(^|[^\p{L}\p{N}_])\d{1,2}[/-]\d{1,2}[/-]\d{2,4}([^\p{L}\p{N}_]|$)"

# fixed values: sentiment words
POSITIVE_WORDS = ["good", "great", "excellent", "amazing", "wonderful", "fantastic", "love", "like"]
NEGATIVE_WORDS = ["bad", "terrible", "awful", "hate", "dislike", "horrible", "worst"]
POSITIVE_WORDS_WIDE = POSITIVE_WORDS + ["best", "awesome"]
NEGATIVE_WORDS_WIDE = NEGATIVE_WORDS + ["poor", "disappointing"]

# fixed values: topic categories and their keywords
TOPIC_KEYWORDS = {
    "business": ["business", "company", "market", "finance", "economy", "profit", "revenue"],
    "technology": ["technology", "software", "computer", "ai", "digital", "tech", "innovation"],
    "sports": ["sports", "game", "team", "player", "match", "score", "championship"],
    "entertainment": ["movie", "music", "celebrity", "entertainment", "show", "actor", "film"],
    "politics": ["politics", "government", "election", "policy", "political", "vote", "democracy"],
}

# fixed values: keywords for caller-chosen categories
CUSTOM_KEYWORDS = {
    "positive": ["good", "great", "excellent", "amazing", "wonderful", "love", "best", "awesome"],
    "negative": ["bad", "terrible", "awful", "hate", "worst", "horrible", "disappointing"],
    "neutral": ["okay", "fine", "average", "normal"],
    "business": ["company", "business", "corporate", "enterprise", "organization"],
    "technology": ["tech", "software", "computer", "digital", "ai", "data"],
    "sports": ["game", "team", "player", "match", "sport", "championship"],
    "entertainment": ["movie", "music", "show", "entertainment", "fun"],
}

# fixed values: stop words of keyword extraction
KEYWORD_STOP_WORDS = [
    "the", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "is", "are", "was", "were",
    "be", "been", "have", "has", "had", "do", "does", "did", "will", "would", "could", "should", "may", "might",
    "must", "can", "this", "that", "these", "those",
]

# fixed values: frequent function words that vote for a language
LANGUAGE_WORDS = {
    "en": ["the", "and", "of", "to", "is", "that", "with", "for", "was", "this", "are", "not"],
    "de": ["der", "die", "und", "das", "nicht", "mit", "ist", "ein", "eine", "auf", "den", "von"],
    "fr": ["le", "la", "les", "et", "des", "est", "une", "dans", "pour", "que", "pas", "sur"],
    "es": ["el", "los", "las", "y", "una", "por", "con", "para", "del", "como", "su", "es"],
}
LANGUAGE_NAMES = {"en": "English", "de": "German", "fr": "French", "es": "Spanish"}
