"""Fixed values that results depend on."""

from __future__ import annotations

# Target languages whose text is set in the pan-script font.
PAN_SCRIPT_LANGUAGES = ("am", "ar", "bn", "bg", "chr", "el", "gu", "iw", "hi", "kn", "ml", "mr", "ru", "sr", "ta", "te", "th", "ur", "uk")
PAN_SCRIPT_FONT = "GoNotoKurrent-Regular.ttf"
# Languages set in a regional serif font.
REGION_LANGUAGES = {"CN": ("zh-cn", "zh-hans", "zh"), "TW": ("zh-tw", "zh-hant"), "JP": ("ja",), "KR": ("ko",)}


def region_font(region: str) -> str:
    return f"SourceHanSerif{region}-Regular.ttf"


def font_file(lang: str) -> str:
    """File of the font that a target language is set in."""
    region = next((r for r, langs in REGION_LANGUAGES.items() if lang.lower() in langs), None)
    return region_font(region) if region else PAN_SCRIPT_FONT


# Line height by target language, as a multiple of the font size.
LINE_HEIGHTS = {"zh-cn": 1.4, "zh-tw": 1.4, "zh-hans": 1.4, "zh-hant": 1.4, "zh": 1.4, "ja": 1.1, "ko": 1.2, "en": 1.2, "ar": 1.0, "ru": 0.8, "uk": 0.8, "ta": 0.8}
OTHER_LINE_HEIGHT = 1.1

# Display names of languages.
LANGUAGE_CODES = {"Simplified Chinese": "zh", "Traditional Chinese": "zh-TW", "English": "en", "French": "fr", "German": "de", "Japanese": "ja", "Korean": "ko", "Russian": "ru", "Spanish": "es", "Italian": "it"}

# Language names of the one service that wants them in words.
LANGUAGE_WORDS = {"zh": "Chinese", "zh-TW": "Chinese", "en": "English", "fr": "French", "de": "German", "ja": "Japanese", "ko": "Korean", "ru": "Russian", "es": "Spanish", "it": "Italian"}

# Display names of services and the registry names behind them.
SERVICE_NAMES = {
    "Google": "google",
    "Bing": "bing",
    "DeepL": "deepl",
    "DeepLX": "deeplx",
    "Ollama": "ollama",
    "Xinference": "xinference",
    "AzureOpenAI": "azure-openai",
    "OpenAI": "openai",
    "Zhipu": "zhipu",
    "ModelScope": "modelscope",
    "Silicon": "silicon",
    "Gemini": "gemini",
    "Azure": "azure",
    "Tencent": "tencent",
    "Dify": "dify",
    "AnythingLLM": "anythingllm",
    "Argos Translate": "argos",
    "Grok": "grok",
    "Groq": "groq",
    "DeepSeek": "deepseek",
    "OpenAI-liked": "openailiked",
    "Ali Qwen-Translation": "qwen-mt",
}
ALWAYS_ENABLED = ("Google", "Bing")

# Page presets; None means every page.
PAGE_PRESETS: dict[str, int | None] = {"All": None, "First": 1, "First 5 pages": 5, "Others": None}
DEMO_PAGE_PRESETS: dict[str, int | None] = {"First": 1, "First 20 pages": 20}

# Layout classes that are left as they are.
EXCLUDED_CLASSES = ("abandon", "figure", "table", "isolate_formula", "formula_caption")
LEAST_CONFIDENCE = 0.25
THICK_LINE = 5

# Characters sent to a service at most.
GOOGLE_CHARS, BING_CHARS = 5000, 1000
# Fixed value: what is stored where a service refuses a text for good.
REFUSED = "IRREPARABLE TRANSLATION ERROR"

# What a model thinks before it answers, at the start of an answer; with dots that match line ends.
THOUGHT = r"^<think>.+?</think>"
THOUGHT_TOLERANT = r"^<think>.+?\n*(</think>|\n)*(</think>)\n*"

# How text and lines are written as drawing operators.
TEXT_OPERATOR = "/%s %f Tf 1 0 0 1 %f %f Tm [<%s>] TJ "
LINE_OPERATOR = "ET q 1 0 0 1 %f %f cm [] 0 d 0 J %f w 0 0 m %f %f l S Q BT "

# Fonts and character categories of formulas, and the Greek block.
FORMULA_FONTS = r"(CM[^R]|MS.M|XY|MT|BL|RM|EU|LA|RS|LINE|LCIRCLE|TeX-|rsfs|txsy|wasy|stmary|.*Mono|.*Code|.*Ital|.*Sym|.*Math)"
FORMULA_CATEGORIES = ("Lm", "Mn", "Sk", "Sm", "Zl", "Zp", "Zs")
MODIFIER_CATEGORIES = ("Lm", "Mn", "Sk")
GREEK = (0x370, 0x3FF)
SUBSCRIPT_RATIO = 0.79
BULLET = "•"

# Drawing operators that are not passed on, beside those that begin with T.
DROPPED_WITH_OPERANDS = ('"', "'", "EI", "MP", "DP", "BMC", "BDC")
DROPPED_WITHOUT_OPERANDS = ("BI", "ID", "EMC")
FILL_OPERATORS = ("f", "F", "f*", "B", "B*")
