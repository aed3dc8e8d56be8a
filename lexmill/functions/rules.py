"""Rules as data. They must equal the published ones for equal results."""

from __future__ import annotations

# Invisible characters, markup and white-space patterns.
INVISIBLE = r"[\u00AD\u200B-\u200F\u202A-\u202E\u2060-\u2064\u206A-\u206F\uFEFF]"
HTML_COMMENT = r"(?s)<!--.*?-->"
HTML_TAG = r"</?[a-zA-Z][^>]{0,200}>"
MD_LINK = r"\[([^\]]{0,200})\]\((https?://[^)\s]{1,500})\)"
URL = r"(?i)https?://[^\s<>\"'\)\]]+"
LONG_BLANKS = r"[ \t\f\x0B]{3,}"
MANY_NEWLINES = r"\n{4,}"

# Fixed values: (rule, weight, case-insensitive pattern).
INJECTION_RULES = (
    ("ignore_previous", 4,
     r"(игнорируй|забудь|не\s+обращай\s+внимания\s+на)\s+(все\s+)?(предыдущи\w+|прошл\w+|прежни\w+|выше)\s*"
     r"(инструкц\w+|указан\w+|промпт\w*|правил\w+)?"
     r"|ignore\s+(all\s+)?(previous|prior|above)\s+(instructions?|prompts?|rules?)|disregard\s+(all\s+)?(previous|prior)\s+"),
    ("role_override", 3,
     r"(ты\s+(больше\s+не|теперь|с\s+этого\s+момента)\s+\w+)|(веди\s+себя\s+как)|(you\s+are\s+(now|no\s+longer))"
     r"|(act\s+as\s+(a\s+)?(dan|developer\s+mode|jailbroken))|(новая\s+рол[ьи])"),
    ("fake_system_block", 4,
     r"(^|\n|<!--)\s*(system|систем\w*)\s*(:|=|>>|\]|prompt)|<\|?(im_start|system|endoftext)\|?>"
     r"|(\[\s*(system|instructions?)\s*\])|(###\s*(system|instruction))"),
    ("instruction_to_assistant", 3,
     r"(инструкц\w+|указан\w+|команд\w+)\s+(для|ассистент\w*|бот\w*|модел\w+|ai|llm)"
     r"|(для\s+(ассистент\w+|бота|модели|llm))|(instructions?\s+(for|to)\s+(the\s+)?(assistant|ai|model|bot))"),
    ("secrecy_request", 3,
     r"(никому\s+не\s+говори|не\s+упоминай\s+(этот|это|данн\w+)|скрой\s+(этот|это)|не\s+сообщай\s+(пользовател\w+|сотрудник\w+))"
     r"|(do\s+not\s+(tell|mention|reveal)|keep\s+this\s+secret)"),
    ("credential_bait", 4,
     r"(универсальн\w+\s+пароль|общий\s+пароль\s+для\s+всех|master\s+password)|(скачайте?\s+.{0,40}\.(zip|exe|msi|bat|ps1))"
     r"|(запустите?\s+.{0,30}\.(exe|bat|ps1|sh)\s+от\s+администратора)|(отправ\w+\s+(пароль|токен|ключ|конфиг))"),
    ("exfiltration_link", 4,
     r"https?://[^\s]{0,200}[?&][^\s]{0,50}=[^\s]{0,50}(<|%3C|\{)?\s*"
     r"(систем\w+\s+промпт|system\s*prompt|текст\s+вопроса|history|context|q=|data=)"),
    ("prompt_leak_request", 3,
     r"(выведи|покажи|повтори|раскрой)\s+(свой\s+)?(системн\w+\s+промпт|инструкц\w+)"
     r"|(repeat|print|reveal)\s+(your\s+)?(system\s*prompt|instructions)"),
    ("tool_abuse", 3,
     r"(вызови|выполни|запусти)\s+(инструмент|функцию|команду|http|curl)|(call\s+the\s+tool|execute\s+the\s+following)"),
    ("base64_blob", 2, r"\b[A-Za-z0-9+/]{120,}={0,2}\b"),
)
# What a match of a rule holds, in lower case: all words of one of its groups. A text without them is not searched for the rule.
INJECTION_HINTS = {
    "ignore_previous": (("игнорируй",), ("забудь",), ("обращай",), ("ignore",), ("disregard",)),
    "role_override": (
        ("больше", "ты"), ("теперь", "ты"), ("момента", "ты"), ("веди", "себя"), ("you", "are", "now"), ("you", "are", "longer"),
        ("act", "as", "dan"), ("act", "as", "developer"), ("act", "as", "jailbroken"), ("новая", "рол")),
    "fake_system_block": (("system",), ("систем",), ("im_start",), ("endoftext",), ("instruction",)),
    "instruction_to_assistant": (("инструкц",), ("указан",), ("команд",), ("для", "ассистент"), ("для", "бота"), ("для", "модели"), ("для", "llm"), ("instruction",)),
    "secrecy_request": (
        ("говори",), ("упоминай",), ("скрой",), ("сообщай",), ("tell", "not", "do"), ("mention", "not", "do"), ("reveal", "not", "do"), ("secret", "keep")),
    "credential_bait": (("пароль",), ("password",), ("скачайт",), ("запустит",), ("отправ",)),
    "exfiltration_link": (("://",),),
    "prompt_leak_request": (("промпт",), ("инструкц",), ("prompt",), ("instructions",)),
    "tool_abuse": (("вызови",), ("выполни",), ("запусти",), ("tool", "call"), ("execute",)),
}
HIDDEN_COMMENT_WEIGHT = 3
RISK_MEDIUM, RISK_HIGH = 3, 6

# Question screening.
QUESTION_PATTERNS = (
    r"забудь\s+(все\s+)?(правила|инструкции)",
    r"игнорируй\s+(предыдущие|все)\s+(правила|инструкции)",
    r"новые?\s+инструкци",
    r"ты\s+больше\s+не\s+ассистент",
    r"ignore\s+(all\s+)?(previous\s+)?instructions",
    r"disregard\s+(the\s+)?(rules|instructions)",
    r"system\s*prompt",
)
SERVICE_TAG = r"(?i)</?\s*context\s*>|</?\s*quote\s*>"
QUESTION_MIN, QUESTION_MAX = 3, 500

# Personal data, in the order of masking.
PII_PATTERNS = (
    ("EMAIL", r"(?U)\b[\w.+-]+@[\w-]+\.[A-Za-zА-Яа-я]{2,}\b"),
    ("PHONE_RU", r"(?<!\d)(?:\+7|8)[\s\-]?\(?\d{3}\)?[\s\-]?\d{3}[\s\-]?\d{2}[\s\-]?\d{2}(?!\d)"),
    ("CARD", r"(?<!\d)(?:\d{4}[\s\-]?){3}\d{4}(?!\d)"),
    ("SNILS", r"(?<!\d)\d{3}-\d{3}-\d{3}[\s]\d{2}(?!\d)"),
    ("INN", r"(?<!\d)(?:\d{10}|\d{12})(?!\d)"),
    ("PASSPORT_RU", r"(?<!\d)\d{2}\s?\d{2}\s?\d{6}(?!\d)"),
    ("IP", r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d.])"),
)
# What every match after EMAIL holds: ten digits with at most three signs between two of them, or three groups of an address.
PII_DIGITS = r"[0-9](?:(?:[\s()\-]{0,3}[0-9]){9}|\.[0-9]{1,3}\.[0-9])"
PRIVATE_IP = r"^(10\.|192\.168\.|127\.|172\.16\.|172\.17\.|172\.18\.)"

# Secrets.
SECRET_PATTERNS = (
    ("OPENAI_KEY", r"\bsk-[A-Za-z0-9_\-]{16,}\b"),
    ("AWS_KEY", r"\bAKIA[0-9A-Z]{12,}\b"),
    ("BEARER", r"(?i)\bBearer\s+[A-Za-z0-9._\-]{16,}\b"),
    ("PASSWORD_KV", r"(?iU)\b(пароль|password|passwd|pwd|секрет|secret|token|api[_\-]?key)\b\s*[:=]\s*\S{4,}"),
    ("PRIVATE_KEY", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)

# Phrases that mark a refusal.
REFUSAL_MARKERS = (
    "нет ответа", "нет информации", "не могу ответить", "не могу дать ответ",
    "не найдено", "нет данных", "в документах нет", "в источниках нет",
)
