"""Word lists and tables of the rule classifiers."""

from __future__ import annotations

# Cues, patterns, stop words and tables that decide what the rules match.

#: Suggestion cues, matched as substrings.
SUGGESTION_CUES = [
    "suggest", "recommend", "advise", "propose", "should", "could", "would", "might", "ought", "why not", "how about", "what about",
    "better if", "would be nice", "wish", "hope", "need to", "have to", "must", "please", "try to", "consider", "it would help", "you may want",
]
IMPLICIT_COMPLAINTS = [
    r"(crash|freeze|bug|error|slow|broken|fail|stuck)",
    r"(too small|too big|too slow|too fast)",
    r"(doesn't work|won't load|can't find|not working)",
]
NEGATIVE_WORDS = [
    "bad", "terrible", "awful", "horrible", "poor", "worst", "annoying", "frustrating", "disappointed", "disappointing", "useless", "waste",
    "mediocre", "inferior", "unacceptable", "defective", "faulty", "unreliable", "inconvenient",
]
SENTENCE_KEYWORDS = ["should", "could", "need", "wish", "would", "please", "hope", "suggest", "add", "fix", "improve", "better", "more"]
#: Suffixes in the order in which the first match is taken off.
SUFFIXES = ["ing", "tion", "ment", "ness", "able", "ible", "ful", "less", "ous", "ive", "ly", "ed", "er", "es", "s"]
DISCOURSE_MARKERS = [
    "also,", "also ", "but ", "but,", "additionally", "on the other hand", "another thing", "furthermore", "moreover", "however", "besides",
    "in addition", "what's more", "not only that", "and also",
]
EVIDENCE_STOPWORDS = [
    "the", "a", "an", "is", "are", "was", "were", "it", "i", "my", "me", "to", "of", "in", "on", "for", "and", "or", "but", "this", "that",
    "with", "at", "by", "from", "not", "so", "be", "has", "have", "had", "do", "does", "did", "would", "could", "should", "can", "will",
    "just", "very", "really", "too", "much", "more", "also", "like",
]
EVIDENCE_STRIP = ".,!?;:'\"()-"
TOPIC_STOPWORDS = ["the", "a", "an", "is", "are", "was", "it", "i", "my", "to", "of", "in", "on", "for", "and", "or", "but", "this"]
INTENT_STOPWORDS = ["the", "a", "an", "to", "of", "in", "for", "and", "or", "is", "it"]
FAITHFULNESS_STOPWORDS = [
    "the", "a", "an", "is", "are", "was", "it", "i", "my", "to", "of", "in", "on", "for", "and", "or", "but", "this", "that", "add", "fix",
    "improve", "implement", "make", "should", "would",
]
ROLE_PATTERNS = {
    "direct_request": [
        r"please\s+\w+", r"can\s+you\s+\w+", r"add\s+\w+", r"implement\s+\w+", r"i\s+want", r"i\s+need", r"should\s+\w+", r"must\s+\w+",
        r"would\s+(?:love|like|appreciate)", r"wish\s+(?:it|there|you)",
    ],
    "complaint_frame": [
        r"(?:so|too|very|extremely)\s+(?:slow|bad|difficult|annoying|frustrating)", r"doesn'?t\s+work", r"broken", r"terrible", r"awful",
        r"can'?t\s+(?:even|use|find|access)", r"keeps?\s+(?:crash|freez|fail)", r"(?:always|never|constantly)\s+\w+(?:ing|s|ed)",
    ],
    "comparison_frame": [
        r"like\s+\w+\s+does", r"(?:better|worse)\s+than", r"(?:unlike|compared\s+to)\s+\w+", r"other\s+(?:apps?|platforms?|sites?)",
        r"\w+\s+(?:has|have|offers?)\s+(?:this|that|it)",
    ],
    "urgency_marker": [
        r"(?:urgent|critical|blocking|emergency)", r"can'?t\s+use\s+(?:at\s+all|anymore)", r"(?:please|asap|immediately|right\s+now)", r"[!]{2,}",
        r"(?:desperate|stuck|helpless|lost)",
    ],
    "modal_verb": [r"(?:should|could|would|might|must|need\s+to)\s+\w+"],
}
DEFAULT_ROLE = "supporting_context"
#: Views of a role, for evidence found by keywords and by patterns.
KEYWORD_VIEWS = {"urgency_marker": "pragmatic", "modal_verb": "syntactic"}
PATTERN_VIEWS = {"direct_request": "syntactic", "urgency_marker": "pragmatic", "modal_verb": "syntactic"}
DEFAULT_VIEW = "semantic"
EXPLICIT_STRONG = [
    "please add", "you should", "i want", "i need", "can you add", "would be great if", "it would help if", "consider adding", "i wish",
    "i'd love", "how about adding", "why not add", "implement", "introduce", "provide", "enable", "allow", "make it possible",
    "add support for", "include",
]
EXPLICIT_MODERATE = [
    "why can't", "why doesn't", "why isn't there", "how come there's no", "there should be", "it should", "must have", "need to have",
    "could you", "would you", "is it possible to",
]
IMPLICIT_SIGNALS = {
    "complaint_to_fix": [
        "so slow", "too slow", "takes forever", "always crashes", "keeps freezing", "doesn't work", "broken", "terrible", "frustrating",
        "impossible to", "can't even", "unusable",
    ],
    "comparison_to_feature": [
        "like instagram", "like spotify", "like amazon", "competitors have", "other apps", "unlike", "compared to", "everyone else has",
        "industry standard",
    ],
    "rhetorical_question": ["why is there no", "how is it possible that", "am i the only one who", "does no one else", "seriously?", "really?", "come on"],
    "sarcasm_reversal": ["oh great", "wonderful", "love how", "amazing that", "\U0001f644", "/s", "sure, that works"],
}
SPLIT_VERBS = [
    "add", "implement", "fix", "improve", "enable", "allow", "introduce", "provide", "include", "remove", "reduce", "increase", "decrease",
    "optimize", "redesign", "update", "create", "build", "support", "make", "integrate",
]
GATE_VERBS = [
    "add", "implement", "fix", "improve", "enable", "remove", "reduce", "increase", "create", "build", "integrate", "redesign", "optimize",
    "support", "allow", "introduce",
]
VAGUE_TARGETS = ["it", "this", "that", "everything", "things", "stuff", "better", "worse"]
TARGET_STOPWORDS = ["the", "a", "an", "to", "for", "in", "on"]
GATE_STOPWORDS = ["the", "a", "an", "to", "for", "in"]
SPECIFIC_NOUNS = [
    "button", "screen", "page", "menu", "option", "feature", "mode", "speed", "time", "size", "font", "color", "layout", "upload", "download",
    "notification", "search", "filter", "sort",
]
INFEASIBLE = ["read my mind", "always work perfectly", "never crash", "instant", "zero latency", "100% uptime", "free forever"]
STANDARD_FEATURES = [
    "dark mode", "filter", "sort", "search", "export", "notification", "font size", "compression", "cancel button", "undo", "bookmark",
    "offline", "password", "two-factor", "profile", "settings",
]
COMPLAINT_MARKERS = [
    "slow", "crash", "freeze", "broken", "terrible", "awful", "frustrating", "impossible", "useless", "annoying", "horrible", "doesn't work",
    "can't", "won't", "never", "always fails",
]
EMPHASIS_WORDS = [
    "really", "very", "extremely", "absolutely", "always", "never", "constantly", "literally", "seriously", "terrible", "awful", "impossible",
    "ridiculous", "unacceptable",
]
AUDIO_HINTS = ["audio:", "tone", "voice", "frustrated", "monotone", "sarcastic", "emphatic", "resigned", "agitated", "disappointed"]
NULL_SENTINELS = ["", "nan", "None", "—"]
TRUE_WORDS = ["true", "1", "1.0", "yes"]
DOMAINS = ["tech_software", "restaurant"]
SEGMENT_WEIGHTS = {"power_user": 0.9, "regular": 0.7, "casual": 0.5}
#: Region type and default box (x, y, w, h) of interface elements.
UI_ELEMENTS = {
    "progress_bar": ("ui_element", (0.1, 0.4, 0.8, 0.08)),
    "upload_button": ("ui_element", (0.3, 0.7, 0.4, 0.1)),
    "error_dialog": ("error_state", (0.15, 0.2, 0.7, 0.5)),
    "error_message": ("error_state", (0.1, 0.3, 0.8, 0.15)),
    "spinner": ("ui_element", (0.4, 0.4, 0.2, 0.2)),
    "navigation": ("ui_element", (0.0, 0.0, 1.0, 0.1)),
    "cancel_button": ("ui_element", (0.6, 0.7, 0.3, 0.08)),
    "font_text": ("ui_element", (0.05, 0.15, 0.9, 0.6)),
    "packaging": ("visual_defect", None),
    "product_damage": ("visual_defect", None),
}
SCORER_WEIGHTS = {
    "view_agreement_ratio": 1.3, "modality_agreement_score": 1.0, "semantic_memory_hit": 0.7, "canonical_frequency_norm": 0.5,
    "past_approval_rate": 0.9, "cluster_size_norm": 1.5, "avg_confidence": 0.7, "has_urgency_markers": 0.4, "user_segment_importance": 0.5,
    "modality_alignment": 0.4, "explicit_bonus": 0.4, "grounding_score": 1.0, "actionability_norm": 0.7, "feasibility_norm": 0.5,
    "faithfulness_score": 0.6, "type_bonus": 0.3,
}
HARD_NEGATIVES = {
    "tech_software": {
        "praise": [
            "love it", "great job", "impressed", "best ever", "5 stars", "highly recommend", "wonderful", "outstanding", "blown away",
            "no complaints", "absolutely love", "really happy", "so glad", "perfect", "love this app", "works perfectly", "great update",
        ],
        "sarcasm": [
            "it is what it is", "not for me", "or maybe not", "i guess", "if you say so", "sure thing", "whatever", "oh great",
            "what a feature", "brilliant design",
        ],
        "status_quo": ["don't change", "keep it as", "love it as is", "please don't"],
        "resolved": ["they fixed it", "was fixed", "already resolved", "working now", "no longer an issue", "latest update fixed", "patched"],
    },
    "restaurant": {
        "praise": [
            "love it", "great job", "impressed", "best ever", "5 stars", "highly recommend", "wonderful", "outstanding", "blown away",
            "no complaints", "amazing food", "best meal", "incredible", "perfect evening", "delicious", "fantastic service",
        ],
        "sarcasm": [
            "it is what it is", "not for me", "or maybe not", "i guess", "if you say so", "sure thing", "whatever", "oh great", "what a treat",
            "lovely experience",
        ],
        "status_quo": ["don't change", "keep it as", "love it as is", "keep the recipe", "don't touch the menu"],
        "resolved": [
            "they fixed it", "was fixed", "already resolved", "under new management now", "they renovated", "much better now",
            "improved since last visit",
        ],
    },
}
IMAGE_TYPES = {".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".png": "image/png", ".webp": "image/webp", ".gif": "image/gif", ".bmp": "image/bmp"}
# End of the fixed values.
