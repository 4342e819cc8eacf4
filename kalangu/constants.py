"""Default parameter values. Every operator takes these as arguments."""

# --- Fixed values: they must stay as they are for results to match. ---

SUPPORTED_LANGUAGES = ("en", "ha", "yo", "ig", "pcm")

ACCENT_ALLOW_LIST = (
    "yoruba", "igbo", "hausa", "nigerian english", "nigerian",
    "edo", "ijaw", "tiv", "efik", "ibibio", "kanuri", "fulani",
    "fulfulde", "idoma", "igala", "urhobo", "nupe", "kalabari",
    "annang", "itsekiri", "ogoni", "isoko", "esan",
    "izon", "nembe", "ikwere", "epie", "bekwarra", "ebira", "alago",
    "hausa/fulani", "hausa fulani", "pidgin", "nigerian pidgin",
)

CLINICAL_KEYWORDS = (
    "patient", "hospital", "doctor", "nurse", "clinic", "medical",
    "diagnosis", "prescription", "treatment", "surgery", "symptom",
    "disease", "infection", "medicine", "blood", "laboratory", "health",
    "therapy",
)

DIACRITIC_SETS = {
    "ha": "ɗɓƙƴŊŋÐðƊƁƘƳ",
    "yo": "ẹọṣẸỌṢṅṄ",
    "ig": "ịụọṅẹỊỤỌṄẸ",
}

# Non-ASCII letters of the Hausa, Yoruba and Igbo alphabets, and Hausa bigrams.
ALPHABET_EXTRAS = {
    "ha": "ɗɓƙƴ",
    "yo": "ẹẸọỌṣṢ",
    "ig": "ịỊọỌụỤ",
}
HAUSA_BIGRAMS = ("ɗa", "ɓa", "ƙa", "ƴa", "ɗi", "ɓi", "ƙi", "ƙu", "ɗu")

LANGUAGE_TOKENS = {
    "en": "<|en|>", "ha": "<|ha|>", "yo": "<|yo|>", "ig": "<|ig|>",
    "pcm": "<|pcm|>", "mixed": "<|mixed|>",
}
TASK_TOKENS = {
    "transcribe": "<|transcribe|>", "translate": "<|translate|>",
    "understand": "<|understand|>",
}

STOPWORDS = (
    "the", "a", "an", "and", "or", "of", "to", "in", "is", "was", "were",
    "be", "been", "being", "have", "has", "had", "do", "does", "did", "will",
    "would", "could", "should", "may", "might", "for", "with", "on", "at",
    "by", "from", "as", "it", "its", "he", "she", "they", "we", "i", "this",
    "that", "these", "those", "his", "her", "their", "our", "but", "not",
    "are", "also",
)

LAB_LABELS = {
    "hap": "happy", "exc": "happy", "ang": "angry", "sad": "sad",
    "neu": "neutral", "fru": "neutral",
}
STEM_LABELS = {
    "01": "neutral", "02": "neutral", "03": "happy", "04": "sad",
    "05": "angry", "06": "neutral", "07": "neutral", "08": "neutral",
}

SAMPLE_RATES = (8000, 16000, 22050, 24000, 44100, 48000)
COUNTRIES = ("NG", "NIGERIA")
FEEDBACK_TASKS = ("transcribe", "emotion", "gender", "analyze")

# Reject-share limits in percent: (fail above, warn below).
GUARDRAILS = {
    "pass1": (30.0, 2.0),
    "preprocess": (2.0, None),
    "pass2": (20.0, 1.0),
    "pass3": (25.0, 1.0),
}

CORPUS_HOURS = {"en": 1700, "ha": 600, "yo": 400, "ig": 80, "pcm": 200}

# --- End of fixed values. ---
