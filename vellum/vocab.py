"""Closed vocabularies, thresholds and patterns.  Fixed values: results depend on them, so they stand here as plain text."""

GATES = ("scope", "coverage", "sufficiency", "audit", "memory")
EXCLUSION_REASONS = ("off-topic", "wrong-population", "no-method", "outside-window", "wrong-language", "retracted", "duplicate", "not-primary", "unobtainable", "vendor-marketing", "not-peer-reviewed")
CONSENSUS = ("strong", "moderate", "contested", "thin", "absent")
CONTRADICTION_CLASSES = ("direct", "scope", "methodological", "version-drift", "interpretive")
VERIFY_STATUS = ("supported", "partial", "unsupported", "contradicted")
VERDICTS = ("include", "exclude", "defer")
STAGES = ("metadata", "abstract", "fulltext")
MODES = ("quick", "standard", "systematic", "interactive")
LOCATOR_OUTCOMES = ("ok", "dead", "blocked", "unreachable", "no-locator")
MEMORY_KINDS = ("preference", "scope", "source", "method", "pitfall", "terminology")
KEEP_SCORE, CITE_SCORE = 6, 7
MIN_CACHED_CHARS, MAX_TEXT_CHARS = 200, 400_000
MEMORY_TOTAL, MEMORY_PER_KIND, MEMORY_CHARS = 40, 12, 200
SAME_ENTRY, NEAR_ENTRY = 0.8, 0.55
PREPRINT_VENUES = ("arxiv", "biorxiv", "medrxiv", "chemrxiv", "ssrn", "research square", "preprints.org", "techrxiv", "psyarxiv", "osf preprints", "hal preprint", "zenodo", "authorea", "jxiv", "essoar", "scielo preprints")
STOP_WORDS = (
    "the", "a", "an", "and", "or", "but", "of", "to", "in", "on", "for", "with", "is", "are", "was", "were", "be", "been", "it", "this", "that", "as", "at",
    "by", "from", "not", "no", "so", "if", "when", "than", "then", "use", "used", "và", "là", "của", "cho", "với", "các", "những", "một", "khi", "thì", "nên",
)
BLANK_ENTRIES = ("", "-", "--", "n/a", "na", "no", "none", "nothing", "skip", "nope", "nah", "không", "khong", "ko", "không có", "khong co", "bỏ qua", "bo qua", "thôi", "thoi")
CITATION = r"\[((?:S|E|CL)\d+)\]"
AS_OF = "evidence current as of|bằng chứng cập nhật đến"
REFERENCES_HEADING = r"##+[ \t]*(?:references|tài liệu tham khảo|bibliography)\b.*"
#: A number that names a place of a text and asserts nothing.  A word boundary stands before each name; before the sign § that means a word character, so a § after a space keeps its number.
NUMBERED_PLACE = r"(?i)(?:(?<![A-Za-z0-9_])(?:table|figure|fig|section|p|pp|chapter|ref)|(?<=[A-Za-z0-9_])§)\.?\s*\d+(?:\.\d+)*"
#: Answers of at most REFUSAL_CHARS characters that decline to remember anything.
REFUSAL_CHARS = 30
REFUSALS = (r"^(no|nope|nah|none|nothing|not)\b", r"^(don'?t|do not)\s+(bother|worry|save|store|remember)", r"^(skip|pass|forget)\s+(it|this|that|for now)", r"^(maybe|another)\s+(later|time|next time)", r"^(thôi|thoi|khỏi|khoi|không|khong|ko|chưa|chua)\b")
#: A question whose newest source is older than this many years has a temporal gap.
STALE_YEARS = 3
