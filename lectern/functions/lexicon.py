"""Word lists, patterns, codes and thresholds that results depend on."""

# speech, names and cues
SPEECH_VERBS = "喃喃道|嘀咕道|低声道|轻声道|笑道|冷笑道|喝道|骂道|叹道|缓缓开口|开口|心想|想道|说道|说|问道|问|答道|答|喊道|喊|叫道|叫|道"
NAME = "[一-龥A-Za-z0-9_]{1,12}?"
ACTOR_NAME = "[一-龥A-Za-z0-9_]{1,12}"
GROUP_NAMES = ["众人", "大家", "二人", "三人", "所有人"]
INNER_VERBS = ["心想", "想道"]
ACTION_CUES = "推门|推开|走进|走出|走向|看见|看向|望见|望向|走|看|望|笑|哭|站|坐|点头|摇头"
TITLES = "师兄|师姐|师妹|师父|殿下|陛下|公子|姑娘|小姐|夫人|大人|先生"
GROUP_CUE_VERBS = "说|说道|道|喊|喊道|答|答道"
DIRTY_PREFIXES = ["看见", "看向", "望见", "听见"]
DIRTY_FRAGMENTS = ["此事", "不能", "知道", "打算", "一个人", "都别", "门外", "可否", "借一步", "带着"]
#: suffixes cut from an attributed name, and (another list) from a candidate
SPEAKER_SUFFIXES = ["皱眉", "点头", "摇头", "抬头", "低头", "缓缓", "看", "望", "笑", "哭", "说", "问", "答", "喊", "叫"]
CANDIDATE_SUFFIXES = ["皱眉", "点头", "摇头", "抬头", "低头", "冷静", "缓缓", "看", "望", "笑", "哭"]
STOP_CANDIDATES = ["他", "她", "它", "问", "说", "道", "答", "喊", "叫", "走", "看", "望", "笑", "哭", "站", "坐"]
FALLBACK_CANDIDATES = ["旁白", "未知"]
LOW_VALUE = ["旁白", "未知", "众人", "大家", "二人", "三人", "所有人", "公子", "姑娘", "师姐", "师兄", "师妹"]
OBSERVE_VERBS = ["看见", "望见", "看向", "望向"]
ALIAS_SKIP_NAMES = ["", "旁白", "未知", "UNKNOWN", "众人"]
ALIAS_TITLE_SUFFIXES = ["公子", "姑娘", "小姐", "夫人", "大人", "先生", "师兄", "师姐", "师妹", "师父"]
SELF_CONNECTORS = ["", "是", "叫", "乃", "就是"]
NARRATOR, UNKNOWN = "旁白", "未知"

# spans and headings (Java syntax)
BRACKET_QUOTE = "「[^「」]{1,1000}」|\"[^\"\n]{1,300}\""
COLON_QUOTE = "[一-龥A-Za-z0-9_]{1,24}?(?:说|说道|问|问道|答|答道|喊|喊道|道|心想|想道)[：:][^。！？!?\n「」\"]{1,240}[。！？!?]"
NOMINAL_AFTER = "\\A(?:的(?![话是都有吗呢啊嘛了吧哦哟])|这个|那个|了?一声)"
FIRST_PERSON = "我(?!们|方|国|家|辈|等)"
CHAPTER_LINE = "(?md)^\\s*(?:第[零一二三四五六七八九十百千万\\d]+[章节回卷].*|Chapter\\s+\\d+.*)\\s*$"
CHAPTER_OFFSET = "(?md)^\\s*(?:第[零一二三四五六七八九十百千万\\d]+[章节回卷]|序章|终章|尾声|幕间|插话|后记|番外|Chapter\\s+\\d+).*$"
CUE_ONLY = (
    "[，,。；;：:\\s]*[一-龥A-Za-z0-9_]{1,24}(?:对|向|冲)?[一-龥A-Za-z0-9_]{0,12}"
    "(?:喃喃道|嘀咕道|低声道|轻声道|笑道|冷笑道|喝道|骂道|叹道|缓缓开口|开口|心想|想道|说道|说|问道|问|答道|答|喊道|喊|叫道|叫|道)[：:，,。\\s]*"
)
MICRO_CONNECTOR = "[，。、！？…—和与或及以]+"
ADDRESSEE_AT_END = "(?:对着?|朝|冲|向|望着?|看向|注视着?)\\s*([一-龥]{2,6})[一-龥，,\\s]{0,20}?(?:说道|说|道|问道|问|答道|喊道)[：:，,「\\s]*$"
ADDRESSEE_ANYWHERE = "(?:对着?|朝|冲|向|望着?|看向|注视着?)\\s*([一-龥]{2,6})(?:[一-龥，,\\s]{0,15}?)(?:说道|说|道|问道|问|答道|喊道)"
SPEECH_AT_END = "(?:说道|说|道|问道|问|答道|答|喊道|喊|叫道|低声道|淡淡道|轻声道|喃喃道|开口道|开口说|如此说|笑道|轻声说|缓缓道|补充道|说着)\\s*[：:，,「\\s]*$"
NAME_VERB_AFTER = "^[，,。！？」\\s]{0,4}([一-龥A-Za-z0-9·]{2,8})(?:[^「」\n]{0,12}?)(?:说道|说|道|问道|问|答道|答|喊|喊道|说着|如此说)"
CN_NUMBER = "[零一二三四五六七八九十百千万\\d]+"
#: (name, pattern, weight); an earlier pattern wins a tie
HEADINGS = [
    ("md_chapter_cn", f"(?md)^#{{1,3}}\\s*第\\s*{CN_NUMBER}\\s*章.*$", 10),
    ("plain_chapter_cn", f"(?md)^第\\s*{CN_NUMBER}\\s*章[：:．.\\s].*$", 8),
    ("cn_hui_jie", f"(?md)^#{{0,3}}\\s*第\\s*{CN_NUMBER}\\s*[回节幕卷篇].*$", 7),
    ("chapter_en", "(?md)^#{0,3}\\s*[Cc]hapter\\s+\\d+.*$", 7),
    ("part_en", "(?md)^#{0,3}\\s*[Pp]art\\s+\\d+.*$", 5),
    ("numbered", "(?md)^#{0,3}\\s*\\d+[.、）)\\s]+\\S.*$", 3),
    ("md_heading", "(?md)^#{1,2}\\s+\\S.*$", 2),
]
SCENE_BREAK = "(?md)^\\s*(?:[*]{3,}|[-]{3,}|[=]{3,}|[—]{3,})\\s*$"
SENTENCE_MARKS = "。！？!?…"
SENTENCE_END = f"[{SENTENCE_MARKS}]+[”』」'\")）]*"

# corrections
SKIP_SPEAKERS = ["旁白", "未知", "众人", "大家", "二人", "三人", "所有人"]
HIGH_CONFIDENCE, FLIP_CONFIDENCE, LEAST_CONFIDENCE = 0.90, 0.65, 0.10
SCENE_PENALTY, ADDRESSEE_PENALTY, JUMP_PENALTY, REPEAT_PENALTY, FLIP_PENALTY = 0.15, 0.15, 0.12, 0.10, 0.05
REGISTRY_SKIP = ["旁白", "UNKNOWN", ""]
DIALOGUE_GAP, CONTEXT_CHARS, MAX_CANDIDATES, RECENT = 150, 120, 8, 4
REVIEW_THRESHOLD = 0.7

# styles
STYLE_ITEMS = [
    "american accent", "australian accent", "british accent", "canadian accent", "child", "chinese accent", "elderly", "female",
    "high pitch", "indian accent", "japanese accent", "korean accent", "low pitch", "male", "middle-aged", "moderate pitch",
    "portuguese accent", "russian accent", "teenager", "very high pitch", "very low pitch", "whisper", "young adult",
]
PITCH_ITEMS = ["moderate pitch", "low pitch", "high pitch", "very low pitch", "very high pitch"]
EMOTIONS = ["neutral", "soft", "cold", "serious", "curious", "angry"]
FEMALE_NAMES = ["米拉", "琉德米拉", "琉德米拉·露利叶", "苏菲", "苏菲亚", "艾莲", "艾蕾欧诺拉", "艾蕾欧诺拉·维尔塔利亚", "莉姆", "莉姆亚莉夏", "菈娜", "史薇特菈娜", "蒂塔", "凡伦蒂娜", "宓莉莎", "茨魅", "艾榭"]
MALE_NAMES = ["堤格尔", "堤格尔维尔穆德", "堤格尔维尔穆德·冯伦", "拉菲纳克", "加雷宁", "村长", "艾略特", "嘉奴隆", "卢里克", "列许", "达马德", "邦纳", "嘉洛诺夫", "塔拉多", "泰纳帝", "罗兰", "莱榭克", "萨安", "克雷伊修", "王子", "国王"]

# compact codes
EMOTION_CODES = {"ne": "neutral", "so": "soft", "co": "cold", "se": "serious", "cu": "curious", "an": "angry"} | {e: e for e in EMOTIONS}
CONFIDENCE_CODES = {"h": "high", "m": "medium", "l": "low", "high": "high", "medium": "medium", "low": "low"}
TYPE_CODES = {"eb": "explicit_before", "ea": "explicit_after", "im": "implicit", "la": "latent", "gr": "group", "un": "unknown"} | {t: t for t in ("explicit_before", "explicit_after", "implicit", "latent", "group", "unknown")}

# speech planning
CJK = "[㐀-䶿一-鿿豈-﫿]"
LATIN_WORD = "[A-Za-z0-9]+(?:[-'][A-Za-z0-9]+)*"
PAUSES = "[，。！？、；：,.!?;:]"
CJK_PER_SECOND, WORDS_PER_SECOND, PAUSE_SECONDS, PAUSE_SHARE = 3.8, 2.4, 0.12, 0.25
LEAST_SECONDS, LEAST_RATIO, MOST_SECONDS, MOST_RATIO, MOST_SLACK, LEAST_UNITS = 0.45, 0.35, 4.0, 2.8, 2.0, 2
VOLUME_BYTES, VOLUME_ITEMS, SILENCE_MS, SAMPLE_BYTES = 512 * 1024 * 1024, 750, 350, 2

# ordered text rules (id, kind, source, target, priority) used when no profile is given
DEFAULT_RULES = [
    ("phrase_fangfo_01", "literal", "彷佛", "仿佛", 100),
    ("phrase_fangfo_02", "literal", "彷彿", "仿佛", 100),
    ("phrase_fangfo_03", "literal", "仿彿", "仿佛", 100),
    ("char_tiao_after_entity_decode", "literal", "䠷", "挑", 95),
    ("phrase_liaojie", "literal", "瞭解", "了解", 95),
    ("char_jie", "literal", "姊", "姐", 94),
    ("phrase_fanfu", "literal", "反覆", "反复", 90),
    ("char_black", "literal", "黒", "黑", 80),
    ("char_drink", "literal", "飮", "饮", 80),
    ("char_lai", "literal", "瀬", "濑", 80),
    ("char_dan", "literal", "弾", "弹", 80),
    ("char_jian", "literal", "剣", "剑", 80),
    ("char_chuan", "literal", "伝", "传", 80),
    ("char_bu", "literal", "歩", "步", 70),
    ("char_jia", "literal", "仮", "假", 70),
    ("char_quan", "literal", "圏", "圈", 70),
    ("pronoun_ni", "literal", "妳", "你", 60),
    ("pronoun_ta", "literal", "牠", "它", 60),
    # (?:✽\s*){3,} without a repeated group, whose depth Java keeps on the stack
    ("decorative_separator", "regex", r"(?U)✽[\s\x1c-\x1f]*✽[\s\x1c-\x1f]*✽[✽\s\x1c-\x1f]*", "***", 50),
]
PRESERVED = ["祂"]
#: Unicode white space and the four separators beside it.
WHITE_SPACE = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
#: Steps of preprocessing that run unless a profile disables them.
PREPROCESS_STEPS = ("html_unescape", "apply_ordered_rules")
#: Characters of a chunk to aim at, and at most.
CHUNK_TARGET, CHUNK_MOST = 6000, 12_000
