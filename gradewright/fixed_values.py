"""Word lists, patterns, score tables, thresholds and labels.

They have to be exactly these for results to be right on Japanese inspection
texts, so they are stated as plain data. Every operator takes its dictionary,
pattern list, table or threshold as an argument; these are the defaults.
"""

# --- columns of the curated corpus -----------------------------------------
PATH_COLUMN = "ファイルパス"
TEXT_COLUMN = "所見"

# --- filter funnel ----------------------------------------------------------
MIN_TEXT_LENGTH = 15
MAX_TEXT_LENGTH = 500
MIN_TRAINING_LENGTH = 10

EXCLUDED_PATTERNS = (
    r"^\s*$",
    r"^\s*[？?]+\s*$",
    r"^\s*[-ー]+\s*$",
    r"^\s*なし\s*$",
    r"^\s*該当なし\s*$",
)

REQUIRED_KEYWORDS = (
    "ひび割れ", "クラック", "亀裂", "鉄筋", "露出", "腐食", "錆", "さび",
    "剥離", "はく離", "剥落", "欠損", "劣化", "変色", "漏水",
    "桁", "床版", "支承", "橋脚", "橋台", "高欄", "伸縮装置", "主桁",
    "横桁", "対傾構", "コンクリート", "鋼材", "塗装",
    "著しい", "顕著", "大きな", "小規模", "軽微", "進行",
)

# --- sentence denoising -----------------------------------------------------
SENTENCE_END = "。"

# Each with a literal that is part of every match.
TEMPORAL_PATTERNS = (
    ("前回", r"前回(より|から|の|点検|調査)"),
    ("前年", r"前年(より|から|の)"),
    ("経時", r"経時(的|変化)"),
    ("新たに", r"新たに.{0,15}(発生|出現)"),
)

MAINTENANCE_PATTERNS = (
    ("補修", r"補修(が|を|は)?(必要|要する|望ましい|検討)"),
    ("予防保全", r"予防保全"),
    ("対策", r"対策(が|を)?(必要|要する|講じ)"),
    ("措置", r"措置(が|を)?(必要|要する)"),
    ("経過観察", r"経過観察(が|を)?(必要|要する)"),
    ("早", r"早(期|急)に.{0,15}(補修|対策|措置|点検|確認)"),
    ("維持管理計画", r"維持管理計画"),
    ("補修", r"補修工法|補修方法"),
)

# --- splits -----------------------------------------------------------------
TEST_SIZE = 800
TRAIN_SIZES = (1000, 2000, 3000, 4000)
SEED = 42
VALIDATION_SHARE = 0.2

# --- quality guard, classic and batch vocabularies --------------------------
CLASSIC_DAMAGE_WORDS = (
    "ひびわれ", "クラック", "鉄筋", "腐食", "剥離", "劣化",
    "変形", "欠損", "漏水", "遊離石灰", "うき", "損傷",
    "破損", "さび", "サビ", "亀裂", "穴", "断面", "貫通",
)
CLASSIC_VAGUE_WORDS = (
    "説明できません", "確認できません", "判断できません",
    "わかりません", "不明です", "確認不可",
    "画像から判断", "画像のみでは",
)
DAMAGE_WORDS = (
    "ひび割れ", "クラック", "剥離", "剥落", "漏水", "さび", "錆",
    "腐食", "変形", "沈下", "損傷", "欠損", "鉄筋", "断面",
    "亀裂", "ひびわれ", "スパリング", "露出",
)
VAGUE_WORDS = (
    "確認できない", "認識できない", "判断できない",
    "見えない", "不明", "わからない",
)

CLASSIC_LOW_TOKENS = 98
LOW_TOKENS = 30
HIGH_TOKENS = 200

MIN_BLOCK = 10
CLAUSE_DELIMITERS = "。、\n"
MIN_CLAUSE = 6

REASON_MISSING_FILE = "No such file or directory"
REASON_NOT_RECOGNIZED = "Not recognized from only image"
REASON_SHORT = "Short description"
REASON_DIRTY = "Dirty or Noisy image"
REASON_RULE_ONLY = "High Quality (rule only)"
REASON_HIGH_QUALITY = "High Quality"
REASON_TOO_SHORT = "Too short / Error output"
REASON_TOO_LONG = "Too long / Possible repetition"
REASON_NO_DAMAGE = "No damage keywords detected"
REASON_UNSPECIFIED = "Unspecified"

# --- keyword structuring ----------------------------------------------------
# label -> alternatives; every word of an alternative has to occur.
TYPE_RULES = (
    ("rebar_exposure", (("鉄筋露出",), ("鉄筋", "露出"))),
    ("section_loss", (("断面欠損",), ("断面", "欠損"))),
    ("spalling", (("剥離",), ("剥落",), ("スパリング",))),
    ("corrosion", (("錆",), ("さび",), ("腐食",))),
    ("crack", (("ひびわれ",), ("ひび割れ",), ("クラック",), ("亀裂",))),
)
SEVERITY_RULES = (
    ("high", (("著しい",), ("激しい",), ("重大",), ("進行中",), ("大規模",), ("大きな",), ("多数",))),
    ("low", (("軽微",), ("初期",), ("小規模",), ("わずか",))),
)
LOCATION_RULES = (
    ("girder", (("主桁",), ("桁",))),
    ("deck", (("床版",), ("舗装",))),
    ("bearing", (("支承",),)),
    ("pier", (("橋脚",), ("橋台",), ("躯体",))),
    ("railing", (("高欄",), ("防護柵",), ("手すり",), ("地覆",))),
)
RISK_OF_TYPE = {
    "rebar_exposure": "structural",
    "section_loss": "structural",
    "corrosion": "durability",
    "crack": "durability",
    "spalling": "aesthetic",
}

# Bilingual rules; words in Latin letters are looked up in the lowercased text.
BILINGUAL_TYPE_RULES = (
    ("rebar_exposure", (("鉄筋",), ("露出",), ("rebar",))),
    ("section_loss", (("断面欠損",), ("section loss",))),
    ("corrosion", (("腐食",), ("corrosion",), ("錆",))),
    ("spalling", (("剥離",), ("spalling",))),
    ("crack", (("ひび割れ",), ("亀裂",), ("crack",))),
)
BILINGUAL_SEVERITY_RULES = (
    ("high", (("重度",), ("深刻",), ("著しい",), ("広範囲",), ("進行",))),
    ("medium", (("中程度",), ("やや",), ("一部",))),
)
BILINGUAL_LOCATION_RULES = (
    ("girder_bottom", (("主桁下面",), ("girder bottom",))),
    ("girder", (("主桁",), ("桁",), ("girder",))),
    ("bearing", (("支承",), ("bearing",))),
    ("deck", (("床版",), ("deck",))),
    ("pier", (("橋脚",), ("pier",))),
    ("support", (("支持",), ("support",))),
)
BILINGUAL_RISK_RULES = (
    ("structural", (("構造",), ("耐力",), ("安全",), ("崩壊",))),
    ("durability", (("耐久",), ("劣化",), ("寿命",))),
)
FEATURE_RULES = (
    ("鉄筋露出", (("鉄筋",),)),
    ("腐食", (("腐食",), ("錆",))),
    ("ひび割れ", (("ひび割れ",),)),
)
RULE_CONFIDENCE = 0.7
ANSWER_CONFIDENCE = 1.0

# --- answers of a judge or structurer --------------------------------------
STRUCTURE_DEFAULTS = {
    "damage_type": "unknown",
    "severity_level": "medium",
    "location": "unknown",
    "risk_factor": "unknown",
}
STRUCTURE_VALUES = {
    "damage_type": ("rebar_exposure", "crack", "corrosion", "spalling", "section_loss", "unknown"),
    "severity_level": ("high", "medium", "low"),
    "location": ("girder", "deck", "bearing", "pier", "railing", "unknown"),
    "risk_factor": ("structural", "durability", "aesthetic", "unknown"),
}
VERDICT_PATTERN = r"VERDICT\s*:\s*(PASS|FAIL)"
REASON_PATTERN = r"REASON_CODE\s*:\s*(.{5,80})"
FLAT_BLOCK = r"\{[^{}]+\}"
# Where a JSON object may sit in an answer, best place first, with its group.
JSON_PLACES = (
    (r"\{[^{}]*+(?:\{[^{}]*+\}[^{}]*+)*+\}", 0),
    (r"(?sU)```json\s*(\{.*?\})\s*```", 1),
    (r"(?sU)```\s*(\{.*?\})\s*```", 1),
    (r"(?s)(\{.*\})", 1),
)
REQUIRED_FIELDS = ("damage_type", "severity", "location", "risk")
JUDGE_TEXT_LENGTH = 800
STRUCTURER_TEXT_LENGTH = 600

# --- scoring ----------------------------------------------------------------
WEIGHTS = {"damage_type": 0.35, "severity": 0.40, "location": 0.15, "risk": 0.10}
SCORE_TABLES = {
    "damage_type": {
        "section_loss": 1.0,
        "rebar_exposure": 0.95,
        "corrosion": 0.85,
        "spalling": 0.75,
        "crack": 0.60,
        "unknown": 0.50,
    },
    "severity": {"high": 1.0, "medium": 0.6, "low": 0.3},
    "location": {
        "girder_bottom": 1.0,
        "girder": 0.95,
        "bearing": 0.90,
        "deck": 0.75,
        "pier": 0.70,
        "support": 0.85,
        "unknown": 0.50,
    },
    "risk": {"structural": 1.0, "durability": 0.75, "aesthetic": 0.30, "unknown": 0.50},
}
DEFAULT_POINTS = 0.5
LEVEL_THRESHOLDS = {5: 0.85, 4: 0.70, 3: 0.50, 2: 0.35, 1: 0.00}
LEVEL_TEXTS = {
    5: "即時補修が必要（構造安全性に重大な影響）",
    4: "早期補修が必要（6ヶ月以内推奨）",
    3: "計画的補修が必要（1〜2年以内）",
    2: "経過観察が必要（定期点検で監視）",
    1: "記録のみ（軽微な損傷）",
}
LEVEL_TEXT_DEFAULT = "優先度不明"
NO_SCORE_CLASSIC = "No Score due to Low Quality Image"
NO_SCORE = "No Score due to Low Quality"
RULE_ONLY_SCORE = "PASS (rule-only, no LLM structuring)"

ORDINALS = {
    "damage_type": {
        "section_loss": 5, "rebar_exposure": 4, "corrosion": 3,
        "spalling": 2, "crack": 1, "unknown": 0,
    },
    "severity": {"high": 2, "medium": 1, "low": 0},
    "location": {
        "girder_bottom": 5, "girder": 4, "bearing": 3,
        "deck": 2, "pier": 1, "support": 2, "unknown": 0,
    },
    "risk": {"structural": 2, "durability": 1, "aesthetic": 0, "unknown": 0},
}

# --- evaluation -------------------------------------------------------------
TIERS = (
    ("excellent", 0.85),
    ("good", 0.75),
    ("acceptable", 0.65),
    ("poor", 0.50),
)
LOWEST_TIER = "very_poor"
PLATEAU_STEP = 0.01
STAGE_HOURS = {"1k": 1.38, "2k": 2.93, "3k": 4.53, "4k": 6.32}

# --- keyword frequency ------------------------------------------------------
MEMBER_WORDS = {
    "主桁": "Main Girder",
    "横桁": "Cross Beam",
    "床版": "Deck Slab",
    "舗装": "Pavement",
    "高欄": "Railing/Parapet",
    "地覆": "Curb",
    "伸縮装置": "Expansion Joint",
    "排水": "Drainage",
    "支承": "Bearing",
    "親柱": "Post",
    "橋脚": "Pier",
    "橋台": "Abutment",
    "壁高欄": "Wall Railing",
}
DAMAGE_TYPE_WORDS = {
    "ひびわれ": "Crack",
    "鉄筋露出": "Rebar Exposure",
    "うき": "Spalling",
    "剥離": "Delamination",
    "腐食": "Corrosion",
    "欠損": "Defect/Missing",
    "遊離石灰": "Lime Efflorescence",
    "土砂詰り": "Soil Clogging",
    "破損": "Fracture",
    "変形": "Deformation",
    "板厚減少": "Thickness Loss",
    "劣化": "Deterioration",
}
TOP_LABELS = 8

# --- columns of graded tables ------------------------------------------------
SCORED_14 = (
    "image_id", "image_path", "assistant_text", "token_count", "cosine_similarity",
    "quality_verdict", "reason_code", "damage_type", "severity_level", "location",
    "risk_factor", "priority_score", "priority_level", "priority_description",
)
SCORED_22 = (
    "image_id", "image_path", "prediction", "ground_truth", "cosine_similarity",
    "assistant_text", "token_count", "quality_verdict", "reason_code", "rule_triggered",
    "llm_used", "guard_elapsed_sec", "damage_type", "severity_level", "location",
    "risk_factor", "priority_score", "priority_level", "priority_description",
    "raw_damage_score", "raw_severity_score", "raw_location_score",
)

# --- curation ------------------------------------------------------------------
FUNNEL_STAGES = ("missing_values", "length_constraint", "excluded_patterns", "missing_keywords")
QUANTIZATION = "Q5_K_M"
METADATA_NAMES = {"image": "filename"}
# Attribute: the column without which it does not count.
METADATA_ATTRIBUTES = {"component_type": "component_type", "damage_type": "component_type"}
