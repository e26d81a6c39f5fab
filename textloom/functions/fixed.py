"""Fixed values that results must equal: decision tables, vocabularies and patterns."""

# Pair decision table: mask -> (signal, pattern name, reason).
PAIR_TABLE = {
    "0000": ("GREEN", "FULLY_UNIQUE", "構造・内容ともに完全な独自記述です。"),
    "0010": ("RED", "UNFORMATTED_CONTENT_COPY", "構造化されていないテキスト間での本文直接コピー・流用が検出されました。"),
    "0011": ("RED", "CLUSTER_UNFORMATTED_CONTENT_COPY", "構造化されていないテキスト間での本文コピーが、複数人クラスタで繰り返されています。"),
    "0100": ("YELLOW", "FORMAT_ONLY_MATCH", "定型構造のみの一致です(内容は独自)。"),
    "0101": ("YELLOW", "CLUSTER_FORMAT_ONLY_MATCH", "複数人で共通テンプレートを使うクラスタ内での定型構造一致です(内容は独自)。"),
    "0110": ("RED", "FORMATTED_PARAPHRASE", "特殊構造内での内容流用・言い換えが検出されました。"),
    "0111": ("RED", "CLUSTER_FORMATTED_PARAPHRASE", "特殊構造内での内容流用が、複数人クラスタで繰り返されています。"),
    "1000": ("GREEN", "STANDARD_STRUCTURE_UNIQUE", "標準的な記述密度を持った独自の文章です。"),
    "1001": ("GREEN", "CLUSTER_DENSE_UNIQUE", "特定グループ内での標準的な記述です。"),
    "1010": ("RED", "PARAPHRASE_DETECTED", "構文構造は独自ですが、内容語の高度な一致(パラフレーズ・語彙置換による流用)が検出されました。"),
    "1011": ("RED", "CLUSTER_PARAPHRASE_GROUP", "複数人による集団的な言い換え・単語置換グループが検出されました。"),
    "1100": ("YELLOW", "COINCIDENTAL_FORMAT_MATCH", "指定課題のフォーマットや文章構造の型が一致しています(本文内容は独自)。"),
    "1101": ("YELLOW", "CLUSTER_FORMAT_SHARING", "複数人で共通テンプレートを使い回しているクラスタです。"),
    "1110": ("RED", "EXACT_COPY_AND_FORMAT_MATCH", "共通フォーマットに沿った文章構造および本文内容の完全なコピーが検出されました。"),
    "1111": ("RED", "CLUSTER_EXACT_COPY", "複数人による集団的な完全コピペネットワークが検出されました。"),
}
UNKNOWN_PAIR = ("YELLOW", "UNKNOWN_PATTERN", "未定義パターンの判定です。確認が必要です。")

# Thresholds of the three bits, the length of a shared span, and the smallest cluster.
H1_LEAST, H2_LEAST, H3_LEAST = 0.35, 0.80, 0.45
SPAN_LEAST, CLUSTER_LEAST, ALL_PAIRS_BELOW = 16, 3, 10
GRAM_K, WINDOW_W = 8, 5

# Audit decision table: (backing, scope) -> (signal, pattern name, Japanese reason, English reason).
AUDIT_TABLE = {
    ("theorem", "universal"): (
        "GREEN", "THEOREM_BACKED_UNIVERSAL", "定理(古典定理・閉形式導出)により裏づけられた全称文です。",
        "Universal claim backed by a theorem (closed-form derivation within a declared formal system).",
    ),
    ("theorem", "measured"): (
        "GREEN", "THEOREM_BACKED_MEASURED", "定理により裏づけられた測定形の文です(裏づけは過剰だが矛盾なし)。",
        "Measured-form sentence backed by a theorem (backing is redundant but consistent).",
    ),
    ("enumerated", "universal"): (
        "GREEN", "ENUMERATED_UNIVERSAL", "全列挙により裏づけられた全称文です。", "Universal claim backed by exhaustive enumeration.",
    ),
    ("enumerated", "measured"): (
        "GREEN", "ENUMERATED_MEASURED", "全列挙により裏づけられた測定形の文です。", "Measured-form sentence backed by exhaustive enumeration.",
    ),
    ("sample", "universal"): (
        "YELLOW", "SAMPLE_ONLY_UNIVERSAL", "標本のみで裏づけられた全称文です。全列挙での昇格か、実測値の形へのスコープダウンが必要です。",
        "Universal claim backed only by a finite sample. Escalate via exhaustive enumeration or down-scope to measured form.",
    ),
    ("sample", "measured"): (
        "GREEN", "SAMPLE_SCOPED_MEASURED", "明示スコープつきの標本実測として裏づけられた文です。",
        "Sentence backed as a finite sample with an explicit scope declaration.",
    ),
    ("unbacked", "universal"): (
        "RED", "UNBACKED_UNIVERSAL",
        "裏づけのない全称文です(ハルシネーション候補)。全列挙で裏づけるか、実測値の形へスコープダウンするまで公開できません。",
        "Universal claim without backing (hallucination candidate). Back it by exhaustive enumeration or down-scope to measured form before publishing.",
    ),
    ("unbacked", "measured"): (
        "YELLOW", "UNBACKED_MEASURED", "裏づけタグのない実測形の文です。数値の出自(確定手段)を確認してください。",
        "Measured-form sentence without a backing tag. Verify the provenance (confirmation method) of the numbers.",
    ),
}

# Vocabularies; their order counts.
QUANTIFIERS_JA = (
    "すべて", "全て", "必ず", "かならず", "常に", "つねに", "決して", "けっして", "任意の", "どの", "いかなる", "一度も", "一回も",
    "どこにも", "どちらも", "どれも", "永遠に", "絶対に", "絶えず", "四六時中", "24時間365日",
)
MODIFIERS_JA = (
    "確実に", "紛れもなく", "明白に", "明らかに", "断じて", "間違いなく", "疑いなく", "自明に", "例外なく", "一切", "必然的に",
    "不可避的に", "自ずと", "おのずと", "疑いようがない", "疑いようもない", "言うまでもなく",
)
QUANTIFIERS_EN = (
    "all", "every", "everyone", "everybody", "everything", "each", "any", "none", "neither", "both", "no", "must",
    "without exception", "invariably", "without fail", "around the clock", "24/7",
)
MODIFIERS_EN = (
    "clearly", "obviously", "undeniably", "undoubtedly", "certainly", "definitely", "inevitably", "necessarily", "absolutely",
    "unquestionably", "indisputably", "beyond doubt", "by definition", "self-evidently", "manifestly", "as everyone knows",
    "it goes without saying",
)
EXCLUSIONS_EN = (
    "not all", "at all", "in all", "after all", "all but", "all rights", "all of a sudden", "once and for all", "for all i know",
    "not every", "every now and then", "every other", "every so often", "not everyone", "not everybody", "not everything",
    "each other", "if any", "without any", "hardly any", "barely any", "scarcely any", "any more", "any longer", "in any case",
    "at any rate", "no longer", "no more", "no doubt", "no wonder", "no matter", "no way", "no less", "no.",
)
ABBREVIATIONS_EN = (
    "mr.", "mrs.", "ms.", "dr.", "prof.", "vs.", "etc.", "e.g.", "i.e.", "cf.", "al.", "fig.", "eq.", "approx.", "ltd.", "inc.",
    "corp.", "no.", "u.s.",
)
BIBLIOGRAPHY_HEADINGS = ("参考文献", "引用文献", "References", "Bibliography", "Works Cited", "Literature Cited")
QUOTE_LEAST = 10
BACKINGS, SCOPES = ("theorem", "enumerated", "sample"), ("universal", "measured")
LANGS = {"ja": (QUANTIFIERS_JA, MODIFIERS_JA), "en": (QUANTIFIERS_EN, MODIFIERS_EN)}

# Risk index, in thousandths.
WEIGHTS = {"heading": 400, "order": 300, "density": 300}
BY_DEPTH, BY_RANK, BY_PATTERNS = (1000, 800, 600, 400, 200), (1000, 700, 400), (500, 750, 1000)
RISK_META = {
    "enabled": True, "signals": ("heading_depth", "section_order", "pattern_density"),
    "weights": {"heading": 0.4, "order": 0.3, "density": 0.3}, "heading_weights": [1.0, 0.8, 0.6, 0.4, 0.2],
    "order_weights": {"first": 1.0, "early": 0.7, "rest": 0.4}, "density_weights": [0.5, 0.75, 1.0],
}

# Encodings tried in turn.
ENCODINGS = ("utf-8", "utf-8-sig", "cp932", "shift_jis", "euc_jp")

# White space as Python's str.strip() has it, for Java's character classes.
WS = r"\x09-\x0d\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
