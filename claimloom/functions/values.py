"""Words, phrases, patterns and defaults that results depend on."""

# Relations in the order in which they are tried, with the words that state them.
RELATIONS = [
    ("causes", "causes"),
    ("leads_to", "leads to"),
    ("increases", "increases"),
    ("reduces", "reduces"),
    ("affects", "affects"),
    ("influences", "influences"),
    ("shapes", "shapes"),
    ("contributes_to", "contributes to"),
    ("correlates_with", "correlates with"),
    ("is_associated_with", "is associated with"),
]

# Phrases of instructions; a statement with one of them yields no triple.
INSTRUCTIONS = [
    "use the following format", "causal research question", "research question:", "questions are in the form",
    "the statements should be", "focus on the causal relationship", "note:", "example:", "this question",
    "write in the first person", "do not repeat", "each question must be",
]

# Beginnings of subjects that are questions.
QUESTION_STARTS = ["what", "how", "why", "when", "who", "which"]

# Quotes that are stripped from subjects and objects.
QUOTES = "\"'“”‘’`"

# Phrases that rule out a sentence, and words that make it causal.
BAD_PHRASES = ["use the following", "format", "this question", "the question", "statements should", "note:", "instruction", "please", "example:"]
CAUSAL_WORDS = [
    "cause", "causes", "caused", "lead to", "leads to", "led to", "increase", "increases", "increased",
    "reduce", "reduces", "reduced", "affect", "affects", "affected", "influence", "influences", "influenced",
]

# Words that are no tokens of a statement, and those of talk about research.
STATEMENT_STOPWORDS = [
    "about", "across", "after", "affects", "because", "between", "causal", "cause", "causes", "effects", "from", "given",
    "increases", "influences", "leads", "question", "questions", "reduces", "statement", "statements", "that", "their",
    "them", "this", "those", "which", "with", "write",
]
STATEMENT_META = [
    "discovery", "evidence", "finding", "findings", "importance", "implications", "interpretation", "knowledge",
    "scientific", "significance", "theories", "theory", "timeline", "timelines", "understanding",
]

# The same for questions.
QUESTION_STOPWORDS = [
    "about", "across", "after", "among", "because", "between", "cause", "causes", "effects", "from", "how", "increases",
    "influences", "into", "lead", "leads", "question", "questions", "reduces", "that", "them", "this", "those", "what",
    "which", "while", "with", "would",
]
QUESTION_META = [
    "discovery", "evidence", "finding", "findings", "importance", "implications", "interpretation", "knowledge",
    "significance", "theories", "theory", "timeline", "timelines", "understanding",
]

# Lines that are no topics.
TOPIC_JUNK = ["topics must be extracted", "follow the guidelines strictly", "endinputendinstruction"]

# Words and names that are no topics of a text, and topics that every text gets.
TOPIC_STOPWORDS = [
    "the", "a", "an", "and", "or", "to", "of", "in", "on", "for", "with", "as", "by", "at", "from", "is", "are", "was", "were", "be", "been", "being",
    "that", "this", "these", "those", "it", "its", "their", "they", "we", "you", "i", "he", "she", "them", "his", "her", "our", "us", "not", "but",
    "can", "could", "should", "would", "may", "might", "will", "also", "more", "than", "into", "about", "over", "under", "between", "within", "across",
    "during", "after", "before", "such", "most", "some", "many", "any", "all", "each", "other", "new", "one", "two",
]
TOPIC_GENERIC = [
    "abstract", "analysis", "article", "articles", "author", "authors", "biorxiv", "data", "document", "documents", "effect", "effects", "finding",
    "findings", "impact", "impacts", "journal", "manuscript", "method", "methods", "paper", "papers", "preprint", "result", "results", "review",
    "reviews", "study", "studies", "supplementary",
]
TOPIC_LAYOUT = ["figure", "table", "et", "al", "http", "https", "www", "pdf"]
TOPICS_ALWAYS = ["association versus causation", "key mechanisms and mediators"]

# Families of relations.
RELATION_FAMILIES = {
    "leads_to": "causes", "leads to": "causes", "results_in": "causes", "results in": "causes", "drives": "causes", "causes": "causes", "cause": "causes",
    "influences": "affects", "influence": "affects", "affects": "affects", "affect": "affects",
    "increases": "increases", "increase": "increases", "raises": "increases", "raise": "increases", "boosts": "increases", "boost": "increases",
    "reduces": "reduces", "reduce": "reduces", "decreases": "reduces", "decrease": "reduces", "lowers": "reduces", "lower": "reduces",
    "supports": "supports", "support": "supports", "enables": "supports", "enable": "supports", "facilitates": "supports", "facilitate": "supports",
}

# What claims are cut at, in this order, rewritten by, and freed of.
CLAUSE_MARKERS = [", which ", " which ", " by ", " due to ", " through ", " allowing ", " because ", " while ", " when "]
REWRITES = [
    (r"\bglucagon[\s-]+like[\s-]+peptide[\s-]+1\b", "glp1"),
    (r"\bglp[\s-]*1\b", "glp1"),
    (r"\bglp1ras?\b", "glp1 receptor agonist"),
    (r"\bglp1 receptor agonists\b", "glp1 receptor agonist"),
    (r"\bindividuals\b", "people"),
    (r"\bpatients\b", "people"),
    (r"\bsubjects\b", "people"),
    (r"\bpersons\b", "people"),
    (r"\bmoving\b", "move"),
    (r"\bmoves\b", "move"),
]
LEADING_PHRASES = [
    "the use of ", "use of ", "treatment with ", "treatment using ", "administration of ", "exposure to ", "the discovery of ",
    "discovery of ", "the presence of ", "presence of ", "an increase in ", "increase in ", "a rise in ", "rise in ",
    "the reduction of ", "reduction of ", "the loss of ", "loss of ", "the decline in ", "decline in ",
]
META_OBJECTS = [
    "our knowledge about ", "our knowledge of ", "our understanding of ", "the understanding of ",
    "the significance of understanding ", "the interpretation of ", "scientific theories about ", "scientific theories of ",
    "the timeline of ", "the evolutionary timeline of ", "knowledge about ", "knowledge of ", "understanding of ",
]
CLAIM_STOPWORDS = ["a", "an", "and", "as", "at", "by", "for", "from", "in", "into", "of", "on", "that", "the", "their", "this", "to", "which", "with"]

# Least overlaps (subject, object) of claims that are one.
CLAIM_OVERLAPS = [(0.85, 0.6), (0.75, 0.8)]

# Relations that tie a topic to a triple, and a focus that is code.
ANCHORS = ["has_subj", "has_obj"]
CODE_FOCUS = r"\b(def|class|import|return|print)\b|get_gpt_response|prompt\):|\bno other text\b|#|\{|\}|\[|\]|::|;|=\s*"

# Tokens of chat formats that labels are freed of.
LABEL_JUNK = ["<|end|>", "<|assistant|>", "answer:"]

# Defaults.
CHUNK_CHARS, ROOT_TOPICS, TOPICS_PER_CHUNK, TOPIC_DEPTH, MAX_TOPICS, QUESTIONS, STATEMENTS = 2000, 18, 6, 3, 500, 2, 2
FOCI, RADII, MAX_NODES, EDGE_COST = 40, [1, 2], [30, 60], 0.25
TOP_MODELS, TOP_CLAIMS, ALPHA, TIER_1, TIER_2, PER_TIER, EXAMPLES, HUB_EDGES = 5, 30, 1.0, 0.60, 0.30, 10, 3, 8

#: Radius of a hover cluster, as the quantile of distances, its floor, how much wider, and its bounds.
HOVER_QUANTILE, HOVER_FLOOR, HOVER_WIDER, HOVER_LEAST, HOVER_MOST = 0.85, 0.05, 1.35, 0.055, 0.22
