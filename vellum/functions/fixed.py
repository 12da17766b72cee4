"""Fixed values that results depend on: word lists, patterns and constants, as text in their natural order."""

# Character classes (usable in Java and in Python patterns).
CJK = "[㐀-䶿一-鿿]"
CJK_WIDE = "[㐀-鿿]"
TOKEN_CHARS = "[㐀-䶿一-鿿぀-ヿ가-힯]"
NUMERAL = "一二三四五六七八九十百"
SENTENCE_END = "[。！？!?；;]$"

# Characters that cleaning removes (soft hyphen, zero-width space, byte order mark).
INVISIBLE = ["­", "​", "﻿"]

# Patterns of lines that are noise.
BULLETS = "^[●•·▪■◆◇○◦‣⁃]+$"
UI_LABEL = r"^(?:Plain\s*Text|Copy\s*code|复制代码|Code|Text)$"
NUMBER_STRIP = r"^(?:\d{1,3}\s+){3,}\d{1,3}$"
NUMBER_RUN = r"^(?:\d{1,4}\s+)+\d{1,4}$"
PAGE_NUMBER = r"^(?:page\s*)?\d{1,4}(?:\s*/\s*\d{1,4})?$"
PROMOTION = (
    r"(?:更多(?:课程|资料|内容).{0,8}(?:联系|添加)|扫码(?:关注|加入)|(?:关注|添加).{0,6}(?:微信|公众号)|课程咨询)"
    r".*?(?:微信|vx|wechat|公众号|二维码)?\s*[:：]?\s*[A-Za-z0-9_-]{4,}"
)

# Patterns of list items, paragraph openers, entries of a table of contents and headings.
LIST_ITEM = rf"^(?:[-*•·]\s+|\(?\d{{1,3}}[.)、]\s*|[{NUMERAL}]+[、.]\s*|[（(][{NUMERAL}0-9]+[）)]\s*)"
PARAGRAPH_OPENERS = ["离线流程", "在线流程", "上述", "因此", "所以", "这两个流程", "在实际工程中", "接下来", "例如", "其中", "同时", "此外", "对于", "通过", "为了", "需要注意", "需要说明", "总体而言", "综上", "最后", "用户查询", "系统会", "该方法", "该流程"]
TOC_ENTRY = r"^\d+(?:\.\d+){1,5}[:：、.]?\s*\S+"
MULTI_NUMBER = r"^(\d+(?:\.\d+){1,5})[、.]?\s+(\S.*)$"
SINGLE_NUMBER = r"^(\d+)[、.]\s+(\S.*)$"
CHAPTER = rf"^第[{NUMERAL}千万0-9]+[篇编章]\s*"
CHAPTER_SECTION = rf"^第[{NUMERAL}千万0-9]+节\s*"
NUMERAL_ITEM = r"^[一二三四五六七八九十]+、\s*\S+"
PAREN_ITEM = r"^[（(][一二三四五六七八九十0-9]+[）)]\s*\S+"
QUESTION = r"^(?:Q(?:uestion)?|问(?:题)?)[：:]\s*"
ANSWER = r"^(?:A(?:nswer)?|答(?:案)?)[：:]\s*"
CALLOUT = r"^(?:注意|警告|提示|说明|重要|备注|Note|Warning|Tip|Important)[：:]\s*"

# Words of explanatory sentences, openings of continued sentences, suspicious openings.
EXPLANATORY = ["用于", "负责", "通过", "需要", "包括", "可以", "进行", "完成", "如果", "导致", "使其", "采用", "使用", "结合", "提供", "希望", "包含"]
CONTINUATIONS = ["但是", "而且", "以及", "并且", "因此", "所以", "其中", "同时", "此外", "或者", "与", "和", "及", "的", "了", "们", "种", "序", "限", "案", "码", "拆开", "强"]
SUSPICIOUS_OPENINGS = ["们", "种", "序", "限", "案", "码", "拆开", "强", "达", "合", "询", "问", "而", "且", "以及", "并且", "其中", "同时", "此外", "因此", "所以"]
LATIN_CONTINUATION = r"^[a-z,.;:)\]]"
GLUED_OPENERS = ["离线流程", "在线流程", "上述", "因此", "这两个流程", "在实际工程中", "接下来"]

# Halves of Chinese words that layouts break apart.
BROKEN_TAILS = ["能翻", "混", "销售技", "因此候", "候", "语义检", "向量", "模型", "数", "函", "参", "返", "结", "识", "优", "查", "处", "分"]
BROKEN_HEADS = ["阅", "杂", "巧", "选", "索", "型", "据", "法", "数", "行", "果", "息", "理", "类", "量", "化", "库", "问", "答"]

# Patterns of program text.
CODE_LINE = (
    r"^(?:from\s+\S+\s+import\s+|import\s+\S+|def\s+\w+\s*\(|class\s+\w+|async\s+def\s+|if\s+.+:|elif\s+.+:|else\s*:|for\s+.+\s+in\s+.+:|"
    r"while\s+.+:|try\s*:|except\b|return\b|with\s+.+:|@\w+|SELECT\b|INSERT\b|UPDATE\b|CREATE\b)"
)
CODE_PUNCTUATION = r"[{}\[\]();=<>]|\w+\s*="
CODE_SIGN = r"[{}\[\]();=<>]|^\s*(?:def|class|import|from|SELECT|INSERT|UPDATE|CREATE)\b"
PYTHON_LINE = (
    r"^\s*(?:@|async\s+def\b|def\b|class\b|from\b|import\b|if\b|for\b|while\b|try\b|with\b|return\b|yield\b|raise\b|break\b|continue\b|pass\b|"
    r"elif\b|else\b|except\b|finally\b|[A-Za-z_]\w*\s*=)"
)
PYTHON_STRONG = r"^\s*(?:async\s+def|def|class|from|import)\b"
PYTHON_FRAGMENT = r"^\s*(?:return|yield|raise|break|continue|pass|elif|else|except|finally)\b"
BLOCK_HEADER = r"^\s*(?:async\s+def|def|class|if|elif|else|for|while|try|except|finally|with|match|case)\b.*:\s*(?:#.*)?$"
JUMP = r"^(?:return|yield|raise|break|continue|pass)\b"
DEDENT = r"^(?:elif|else|except|finally|case)\b"
DEFINITION = r"^\s*(?:async\s+def|def|class)\b"
MALFORMED_CODE = [r"\bimport[ \t]+\w+[ \t]+from[ \t]+", r"\)\s*(?:def|class|import|from)\s+", r"(?m)^def\s+.+:\n(?!\s)", r"\breturn\b[^\n]{0,80}\breturn\b"]
CONTINUED_CODE = "    # PDF 代码续段：保留函数签名以提供检索上下文"

# Sentence boundaries.
SENTENCE_BOUNDARY = r"(?<=[。！？!?；;])\s*|(?<=\.)\s+(?=[A-Z0-9])|\n{2,}"

# Labels in titles, prefixes and continued lists.
DEFAULT_TITLE = "文档正文"
LIST_TITLE = "列表"
CONTINUED = "（续）："
PREFIX_FILE, PREFIX_KIND, PREFIX_PATH, PREFIX_PAGE = "文档：", "记录类型：", "章节：", "页码："

# Query rewriting and the synonym dictionary.
FILLERS = ["请问", "一下", "呢", "啊", "吧"]
HOW = ["怎么", "怎样"]
SYNONYMS = [("保险理赔", "保险索赔"), ("保险理赔", "理赔"), ("保险理赔", "索赔流程"), ("保险理赔", "理赔流程"), ("理赔", "索赔"), ("理赔", "赔付")]

# Weights of the hashing encoder's features and of the memory score.
FEATURE_WEIGHTS = {"c1": 0.35, "c2": 1.0, "c3": 0.65, "w1": 1.0, "w2": 0.7, "raw": 1.0}
MEMORY_WEIGHTS = (0.65, 0.2, 0.15)
MEMORY_NO_OVERLAP = 0.25
