"""Patterns, word lists, limits and formats that results depend on.

Everything in this file is data. Operators take these as default arguments, so a deployment with another
vocabulary passes its own lists.
"""

# --- white space -----------------------------------------------------------------------------------------
# The characters str.strip() and the regex class \s treat as white space in Python, spelled out because
# Java's \s and SQL trim() know only the ASCII ones.
SPACE_CHARS = (
    " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
SPACE = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
# Characters that are no white space, for a quick look-ahead in front of the long classes.
PRINTABLE = r"[!-~\x{A1}-\x{167F}\x{3001}-\x{10FFFF}]"
# The same as SPACE without the plain blank.
WIDE_SPACE = r"[\t-\r\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
NON_SPACE = r"[^\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"

# --- secret redaction: (pattern, replacement), applied in this order ---------------------------------------
INDEX_REDACTION = (
    (r"\b\d{6,}:[A-Za-z0-9_-]{20,}\b", "<telegram-token-redacted>"),
    (r"sk-[A-Za-z0-9_-]+", "sk-<redacted>"),
    (r"dashscope-[A-Za-z0-9_-]+", "dashscope-<redacted>"),
    (rf"(?i)(password|passwd|api[_ -]?key|secret|token){SPACE}*[:=]{SPACE}*{NON_SPACE}+", "$1=<redacted>"),
    (rf"(?i)(password|passwd|api[_ -]?key|secret|token){SPACE}+{NON_SPACE}+", "$1 <redacted>"),
    (rf"(密码|口令|密钥|令牌|验证码|校验码){SPACE}*[：:=]?{SPACE}*{NON_SPACE}+", "$1<redacted>"),
)
PUSH_CHAT_REDACTION = (
    (r"bot\d+:[A-Za-z0-9_-]+", "bot<redacted>"),
    (r"\b\d{6,}:[A-Za-z0-9_-]{20,}\b", "<telegram-token-redacted>"),
    (r"sk-[A-Za-z0-9_-]+", "sk-<redacted>"),
)
# The separator class of the last two holds a backslash and the letter s, not white space.
POLLED_CHAT_REDACTION = PUSH_CHAT_REDACTION + (
    (r"\bcli_[A-Za-z0-9]+\b", "cli_<redacted>"),
    (r"(?i)(app[_ -]?secret[\"'=:\\s]+)[A-Za-z0-9_-]{8,}", "$1<redacted>"),
    (r"(?i)(encrypt[_ -]?key[\"'=:\\s]+)[A-Za-z0-9_-]{8,}", "$1<redacted>"),
)
# A lower-case text without any of these cannot match a rule above, so no pattern is run on it.
REDACTION_CLUES = ("sk-", "dashscope-", "passw", "secret", "token", "cli_")
REDACTION_CLUE_PAIRS = (("api", "key"), ("encrypt", "key"))
REDACTION_CJK_CLUES = ("密码", "口令", "密钥", "令牌", "验证码", "校验码")
REDACTION_NUMBER_CLUE = r"[0-9]{6}:|bot[0-9]+:"

# --- publish gate ------------------------------------------------------------------------------------------
PUBLISH_SECRET_PATTERNS = (
    r"gh[pousr]_[A-Za-z0-9]{20,}",
    r"-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----",
    r"(?i)(?:password|client[_-]?secret|access[_-]?token|refresh[_-]?token|api[_-]?key)\s*[:=]\s*['\"][^'\"]{8,}['\"]",
)
# For each pattern: a text that matches holds a substring of every group; for one that ignores case also a word in lower case.
PUBLISH_SECRET_CLUES = (
    (("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),),
    (("-----BEGIN ",),),
    (("'", '"'), (":", "=")),
)
PUBLISH_SECRET_WORDS = (None, None, ("password", "secret", "token", "api"))
PUBLISH_DENIED_NAME_PARTS = ("token_cache", ".onepkg", ".onetoc2")
PUBLISH_MAX_BYTES = 10 * 1024 * 1024

# --- relevance hints and noise markers (substring tests on case-folded text) ------------------------------
INDEX_HINTS = (
    "lab", "实验", "采购", "报价", "invoice", "quotation", "quote", "order", "shipment", "delivery", "laser",
    "cavity", "finesse", "finess", "vacuum", "dds", "artiq", "yb", "ion", "atom", "optical", "moku",
    "liquid instruments",
)
INDEX_NOISE = (
    "verification code", "login code", "security code", "one-time code", "验证码", "登录码", "安全码",
    "unsubscribe", "newsletter", "promotion", "广告", "营销",
)
DIGEST_HINTS = (
    "quote", "quotation", "invoice", "purchase", "order", "po", "rfq", "shipping", "delivery", "laser", "cavity",
    "vacuum", "chamber", "pump", "optics", "dds", "ttl", "artiq", "yb", "实验", "采购", "报价", "发票", "订单",
    "物流", "激光", "真空", "光学",
)
OTP_PATTERNS = (
    r"\b(?:verification|security|login|sign[- ]?in|authentication|confirm(?:ation)?)\s+code\b",
    r"\b(?:one[- ]?time password|otp|2fa|two[- ]?factor)\b",
    r"(?:验证码|校验码|动态码|一次性密码|登录代码|安全代码)",
)
AD_PATTERNS = (
    r"\b(?:unsubscribe|newsletter|marketing email|special offer|limited time offer|exclusive offer|promotion|promo code)\b",
    r"(?:退订|取消订阅|广告|促销|推广|优惠券|限时优惠|新品推荐)",
)
WEAK_NOISE = (
    "sale", "discount", "deal", "webinar", "subscribe", "account", "password", "login", "verify", "验证码", "登录",
    "订阅", "促销",
)
OTP_REASON = "verification_or_login_code"
AD_REASON = "advertising_or_newsletter"

# --- question analysis -------------------------------------------------------------------------------------
LATIN_TERM = r"[A-Za-z0-9][A-Za-z0-9_.+-]{1,}"
CJK = r"[\x{3400}-\x{9fff}]"
CHUNK_STOP_CHARS = "我们你您他她它这那哪的了是有在和与及或吗呢啊吧呀几多少什么怎么如何请问大师兄实验室"
PAGE_STOP_CHARS = "我们你您他她它这那哪的了是有在和与及或吗呢啊吧呀几多少什么怎么如何请问大师兄"
# Each rule: every group must have a member in the case-folded question; then the text is appended.
CHUNK_ALIASES = (
    ((("finess", "finesse", "精细", "细度"),),
     "finesse finess 精细度 optical cavity cavity mirror FSR linewidth free spectral range"),
    ((("cavity", "腔"),), "optical cavity in-vacuum cavity out-of-vacuum cavity 稳频腔 腔镜"),
    ((("真空",), ("烤", "bake")), "真空烘烤 真空烤 bakeout baking heating tape 加热带"),
    ((("dds",),), "DDS ARTIQ Urukul 测试 验收 频率 功率 RF"),
    ((("电脑", "计算机", "computer"),), "computer lab computers workstation mini PC 电脑 计算机"),
    ((("邮件", "email"),), "email Gmail forwarded mail attachment"),
    ((("lark", "飞书"),), "Lark 飞书 group chat message"),
)
PAGE_ALIASES = (
    ((("cavity", "腔"), ("finesse", "精细", "细度")),
     "optical cavity finesse 精细度 Out-of-vacuum optical cavity test Cavity mirror Finesse"),
    ((("真空",), ("烤",)), "真空烘烤"),
    ((("电脑", "计算机"),), "Lab computers 计算机数量"),
    ((("台子", "光学平台"),), "光学平台采购数量"),
    ((("dds",),), "DDS ARTIQ 测试 验收"),
)

# --- scoring -----------------------------------------------------------------------------------------------
PHRASE_BONUS, ALIAS_BONUS, TITLE_BONUS, SECTION_BONUS = 12.0, 6.0, 4.0, 2.0
SHORT_TERM_WEIGHT, LONG_TERM_WEIGHT, TERM_COUNT_CAP = 1.6, 2.2, 4
SEMANTIC_SHARE, LEXICAL_SHARE, LEXICAL_HALF_POINT = 0.68, 0.32, 10.0
PAGE_FIELD_WEIGHTS = {
    "title": 5.0, "section": 3.0, "summary": 3.0, "what_happened": 2.2, "important_facts": 2.5,
    "decisions_or_conclusions": 2.5, "open_questions_or_next_steps": 2.0, "people_organizations_equipment": 1.5,
    "tags": 2.0, "attachments": 1.2,
}
MEMORY_TAG_BONUS, MEMORY_TITLE_BONUS = 3, 5
HIGH_BAND, MEDIUM_BAND = 20.0, 8.0
CANDIDATES, CANDIDATES_MIN, RERANK_WIDTH, ANSWER_WIDTH = 40, 10, 24, 8
DEFAULT_TOP_K, MAX_TOP_K = 5, 8
PAGE_TOP_K, MEMORY_TOP_K, FILE_TOP_K = 5, 10, 3
CHUNK_SNIPPET, PAGE_SNIPPET, MEMORY_SNIPPET, RERANK_SNIPPET = 900, 360, 220, 1000
UNKNOWN_ANSWER = "no clear record found"

# --- chunking ----------------------------------------------------------------------------------------------
CHUNK_CHARS, CHUNK_OVERLAP, CHUNK_MIN = 1800, 220, 30
EXPORT_CHARS = 5000
CHUNK_ID_HEX, DISTILLED_ID_HEX, RECORD_ID_HEX, ARCHIVE_HASH_HEX = 20, 16, 18, 16

# --- local distillation ------------------------------------------------------------------------------------
KEYWORD_TAGS = (
    ("artiq", "ARTIQ"), ("dds", "DDS"), ("ttl", "TTL"), ("laser", "laser"), ("aom", "AOM"), ("eom", "EOM"),
    ("mot", "MOT"), ("cavity", "cavity"), ("vacuum", "vacuum"), ("ion", "ion"), ("atom", "atom"),
    ("optical", "optical"), ("temperature", "temperature"), ("purchase", "purchase"), ("quotation", "quotation"),
    ("renovation", "renovation"), ("computer", "computer"), ("website", "website"), ("验收", "验收"),
    ("真空", "真空"), ("激光", "激光"), ("离子阱", "离子阱"), ("采购", "采购"), ("报价", "报价"), ("温度", "温度"),
    ("烘烤", "烘烤"),
)
NEXT_STEP_WORDS = (
    "next", "todo", "should", "need", "pending", "issue", "problem", "下一步", "需要", "建议", "问题", "联系", "待",
)
OUTCOME_WORDS = (
    "result", "conclusion", "problem", "issue", "原因", "结果", "问题", "方案", "完成", "验收",
)
FACT_PATTERN = (
    r"(\d+(?:\.\d+)?\s?(?:nm|MHz|GHz|kHz|mW|W|V|A|mm|cm|m|Torr|Pa|℃|C|dbm|dBm|USD|HKD|RMB|¥|%))"
    r"|(\b20\d{2}[-/]\d{1,2}[-/]\d{1,2}\b)|(\b\d{1,2}/\d{1,2}/20\d{2}\b)"
)
MAX_TAGS, MAX_FACTS, MAX_STEPS, SUMMARY_CHARS = 12, 8, 6, 320
SECTION_FACTS_PER_PAGE, SECTION_FACTS, SECTION_TAGS, SECTION_SUMMARY_TAGS = 2, 12, 12, 8
MIN_SENTENCE, FACT_MIN_CHARS, FACT_MAX_CHARS = 8, 20, 260
MANIFEST_PREVIEW, ADDED_PREVIEW = 260, 1000

# --- HTML --------------------------------------------------------------------------------------------------
INDEX_BLOCK_TAGS = ("p", "div", "br", "tr", "table", "li", "h1", "h2", "h3", "h4", "section", "article")
PAGE_BLOCK_TAGS = ("p", "div", "br", "tr", "table", "li", "h1", "h2", "h3")
INDEX_SKIP_TAGS = ("script", "style", "head", "noscript")
PAGE_SKIP_TAGS = ("script", "style", "head")

# --- channels ----------------------------------------------------------------------------------------------
CHANNEL_KINDS = {"telegram": ("note", "file", "mode", "admin"), "lark": ("chat", "note", "file")}
DIGEST_KINDS = {"telegram": ("note", "file"), "lark": ("chat", "note", "file")}
CHANNEL_SECTIONS = ("Telegram Records", "Email Records", "Lark Records")
UNSORTED_SECTION = "Unsorted Communication Records"
RECORD_SECTION, ATTACHMENT_SECTION = "Communication Records", "Communication Attachments"
CONTEXT_TURNS, CONTEXT_AGE_SECONDS, CONTEXT_KEPT = 6, 1800, 10
SEEN_LIMIT = 5000
MILLIS_THRESHOLD = 10_000_000_000
SELF_DOC_FILE_CHARS, SELF_DOC_TOTAL_CHARS = 18000, 125000
MAX_DIFF_LINES, DIFF_CONTEXT = 500, 3

# --- files -------------------------------------------------------------------------------------------------
INDEX_TEXT_SUFFIXES = (
    ".txt", ".md", ".markdown", ".html", ".htm", ".csv", ".tsv", ".json", ".yaml", ".yml", ".log", ".tex", ".xml",
)
TEXT_SUFFIXES = (
    ".txt", ".md", ".markdown", ".html", ".htm", ".csv", ".tsv", ".json", ".yaml", ".yml", ".log", ".py", ".m",
    ".tex", ".xml",
)
EXPORT_TEXT_SUFFIXES = (".txt", ".md", ".log", ".csv", ".tsv", ".json", ".yaml", ".yml")
IMAGE_SUFFIXES = (".jpg", ".jpeg", ".png", ".webp", ".gif", ".bmp")
BINARY_SUFFIXES = (
    ".step", ".stp", ".exe", ".dll", ".dylib", ".app", ".zip", ".7z", ".rar", ".tar", ".gz", ".dmg",
)
FILE_REQUEST_PHRASES = (
    "请给我", "给我", "发给我", "发送", "找一下", "找", "说明书", "pdf", "文件", "manual", "datasheet",
)
FILE_REQUEST_FILLERS = ("一下", "这个", "那个")
FILE_REQUEST_WORDS = ("给我", "发", "发送", "说明书", "pdf", "manual", "datasheet", "文件")

# --- commands and intents ----------------------------------------------------------------------------------
RECORD_ON_WORDS = ("/开始记", "开始记", "开始记录", "/record_on")
RECORD_OFF_WORDS = ("/停止记", "停止记", "停止记录", "/record_off")
HELP_EXACT = ("/help", "help", "commands")
HELP_PHRASES = (
    "怎么用", "如何使用", "使用说明", "帮助", "命令", "指令", "有哪些指令", "有什么指令", "能干什么", "可以干什么",
)
# The names an assistant answers to differ by deployment; operators take them as an argument.
ASSISTANT_NAMES = ("bot", "机器人")
HELP_PATTERNS = (
    r"(有哪些|有什么|支持|可用|所有).{0,6}(指令|命令|功能)",
    r"(指令|命令|功能).{0,6}(列表|说明|帮助)",
    r"(怎么|如何).{0,8}(使用|操作).{0,8}(bot|机器人|telegram|入口)",
)
HELP_FILLER = r"^(你|您|这个|这个bot|这个机器人)+"
HELP_PUNCTUATION = r"[\s，。！？,.!?：:；;、]+"
INTENT_PUNCTUATION = r"[\s，。！？,.!?：:；;、~～]+"
CASUAL_WORDS = (
    "你好", "您好", "hello", "hi", "hey", "哈喽", "在吗", "在不在", "早", "早上好", "中午好", "下午好", "晚上好",
    "辛苦了", "谢谢", "多谢", "感谢", "thx", "thanks",
)
LAB_QUERY_MARKERS = (
    "几台", "几个", "几张", "多少", "参数", "型号", "价格", "报价", "买过", "采购", "做过", "测过", "怎么测", "怎么用",
    "怎么做", "谁", "什么时候", "记录", "notebook", "电脑", "dds", "真空", "烘烤", "光学平台", "实验室", "lab",
)
FOLLOWUP_MARKERS = (
    "那", "这个", "那个", "它", "上面", "刚才", "前面", "后面", "前者", "后者", "继续", "展开", "详细", "具体", "为什么",
    "怎么", "如何", "多少", "几", "谁", "哪", "证据", "来源", "原文", "链接", "步骤", "参数", "价格", "型号", "时间",
    "还有", "呢",
)
FOLLOWUP_START = r"(?i)^(and|what about|how about|why|where|which|when|then)\b"
FOLLOWUP_SHORT, FOLLOWUP_LONG = 8, 28
NOTE_VERBS = "记一下|记录一下|保存一下|记住|记录|保存"
NOTE_VERBS_EN = "note|remember|record"
ALLOW_WORDS = ("白名单", "allowlist", "allowed_chat_ids", "授权", "允许访问", "加入", "写进", "加进")
CHAT_ID_PATTERN = r"(?<!\d)(\d{6,15})(?!\d)"
REPLY_COMMANDS = ("/id", "/help", "/status", "/ask", "/note")
READABLE_KEYS = (
    "title", "text", "un_escape_text", "url", "href", "file_name", "name", "doc_title", "document_title", "link",
)
REPLY_PRIORITY_WORDS = ("解决", "正常", "成功", "结论", "滤波", "功放", "避免", "参数", "温度", "时间")

# --- memory entries ----------------------------------------------------------------------------------------
ENTRY_ID_PATTERN = r"^[a-z0-9][a-z0-9_-]{2,80}$"
ENTRY_DATE_PATTERN = r"^\d{4}-\d{2}-\d{2}$"
ENTRY_TYPES = (
    "notebook_page", "document", "experiment", "protocol", "result", "decision", "meeting", "dataset", "code",
    "instrument", "idea", "hypothesis",
)
ENTRY_STATUS = ("draft", "active", "superseded", "archived")
ENTRY_CONFIDENCE = ("low", "medium", "high")
