"""Detection rules as data, and the checks of user rules."""

from __future__ import annotations

import json
import os
import re
import unicodedata
from dataclasses import dataclass, field

STRENGTH = {"literal": 0, "env_reference": 1, "redacted": 2, "block": 3}
#: The weakest restore policy that an entity type may have.
FLOOR = {
    "API_KEY": "env_reference", "OAUTH_TOKEN": "env_reference", "JWT": "env_reference", "PRIVATE_KEY": "env_reference", "PASSWORD": "env_reference",
    "DB_CONNECTION_STRING": "env_reference", "GENERIC_SECRET": "env_reference", "JP_MY_NUMBER": "block", "CREDIT_CARD": "block",
}
#: Shapes of aliases.
PROFILES = ("prose_identifier", "hostname", "email", "ipv4", "ipv6", "uuid", "numeric", "file_path", "url", "environment_reference")
#: Detectors whose hits inside a UUID are dropped.
GUARDED = ("jp_phone", "formats", "jp_my_number", "jp_corporate_number", "jp_postal_code", "jp_identifiers", "date_of_birth")
#: Fixed value: a UUID.
UUID = r"(?<![0-9a-fA-F])[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}(?![0-9a-fA-F])"


@dataclass(frozen=True)
class Rule:
    """One pattern, matched on the normal form of a text. The span is that of ``group``; ``check`` names a function of
    checksums that the value must satisfy; with ``words`` a hit near one scores ``near`` instead of ``score``, and
    ``needs`` ("words", "words or mark") drops others; ``mark`` is a pattern on the value that counts as context;
    ``after`` are words that count if they follow within 12 characters."""

    detector: str
    entity: str
    pattern: str
    score: float
    priority: int
    profile: str
    policy: str
    check: str = ""
    words: tuple[str, ...] = ()
    window: int = 20
    near: float | None = None
    needs: str = ""
    mark: str = ""
    after: tuple[str, ...] = ()
    extra: dict = field(default_factory=dict)
    #: a text without any of these cannot match, so the pattern isn't tried
    hints: tuple[str, ...] = ()
    group: int = 0


@dataclass(frozen=True)
class Terms:
    """Dictionary values of one kind, found all at once however many there are."""

    entity: str
    values: tuple[str, ...]
    priority: int = 100
    policy: str = "literal"
    profile: str = "prose_identifier"
    ignore_case: bool = False
    spaced: bool = True
    detector: str = "dictionary"


# Patterns, keywords, scores and priorities of the public formats.
PUNCT = r"\s@,;:<>()\[\]\\\"'、。，．！？「」『』（）"
DOMAIN = rf"[^{PUNCT}]+\.(?:[A-Za-z]{{2,}}|[^{PUNCT}.]{{2,}})"
#: The characters of a local part, and those before a local part that may hold hiragana too.
LOCAL, LOCAL_AFTER_MARK, MARKS = rf"[^{PUNCT}぀-ゟ]", rf"[^{PUNCT}]", r"[\s:：「『（【>=,]"
IPV4 = r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d.])"
CARD = r"(?<!\d)(?:\d[ -]?){13,19}(?!\d)"
PREFECTURES = (
    "北海道", "青森", "岩手", "宮城", "秋田", "山形", "福島", "茨城", "栃木", "群馬", "埼玉", "千葉", "東京", "神奈川", "新潟", "富山", "石川", "福井", "山梨", "長野",
    "岐阜", "静岡", "愛知", "三重", "滋賀", "京都", "大阪", "兵庫", "奈良", "和歌山", "鳥取", "島根", "岡山", "広島", "山口", "徳島", "香川", "愛媛", "高知", "福岡",
    "佐賀", "長崎", "熊本", "大分", "宮崎", "鹿児島", "沖縄",
)
WHOLE = {"北海道": "北海道", "東京": "東京都", "京都": "京都府", "大阪": "大阪府"}
PREFECTURE = "(?:" + "|".join(WHOLE.get(p, p + "県") for p in PREFECTURES) + ")"
PHONE_WORDS = ("電話", "TEL", "Tel", "tel", "携帯", "連絡先", "内線", "phone", "mobile", "fax", "FAX")
PHONES = (
    r"\+81[ -]?\d{1,4}[ -]?\d{1,4}[ -]?\d{3,4}",
    r"0120[ -]?\d{3}[ -]?\d{3}",
    r"0\d{1,4}[-(（]\d{1,4}[-)）]\d{3,4}",
    r"0[789]0[ -]?\d{4}[ -]?\d{4}",
    r"0\d{1,4}[ -]\d{1,4}[ -]\d{3,4}",
)
ADDRESS = (
    r"(?:〒?\s?\d{3}-\d{4}\s?)?" + PREFECTURE + r"[^\s、。,「」（）()0-9]{1,20}?\d+(?:丁目|番地?|号|[-−])[0-9丁目番地号\-−]*"
    r"(?:(?:ビル|マンション|アパート|ハイツ|荘|タワー)[^\s、。,「」（）()]{0,12})?"
)
BIRTH_WORDS = ("生年月日", "誕生日", "生まれ", "DOB", "dob", "年齢", "才", "歳")
BIRTHS = (r"\d{4}年\s?\d{1,2}月\s?\d{1,2}日", r"(?:明治|大正|昭和|平成|令和)\s?\d{1,2}年\s?\d{1,2}月\s?\d{1,2}日", r"\d{4}[/-]\d{1,2}[/-]\d{1,2}")
MY_NUMBER_WORDS = ("マイナンバー", "個人番号", "個人番号カード", "番号カード", "扶養控除", "源泉徴収", "税", "社会保障", "マイナ")
CORPORATE_WORDS = ("法人番号", "会社", "株式会社", "有限会社", "合同会社", "登記", "法人", "適格請求書", "インボイス", "登録番号", "事業者")
SECRETS = (
    ("API_KEY", r"(?<![A-Za-z0-9])sk-(?:ant-|proj-)?[A-Za-z0-9_-]{20,}", "sk-"),
    ("OAUTH_TOKEN", r"(?<![A-Za-z0-9])(?:gh[pousr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{22,})", "gh"),
    ("API_KEY", r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[0-9A-Z]{16}(?![0-9A-Za-z])", "AKIA", "ASIA"),
    ("OAUTH_TOKEN", r"(?<![A-Za-z0-9])xox[abeoprs]-[A-Za-z0-9-]{10,}", "xox"),
    ("API_KEY", r"(?<![A-Za-z0-9])[sr]k_(?:live|test)_[A-Za-z0-9]{16,}", "k_live_", "k_test_"),
    ("API_KEY", r"(?<![A-Za-z0-9])AIza[0-9A-Za-z_-]{35}", "AIza"),
    ("API_KEY", r"(?<![A-Za-z0-9])npm_[A-Za-z0-9]{36}", "npm_"),
    ("OAUTH_TOKEN", r"(?<![A-Za-z0-9])pypi-[A-Za-z0-9_-]{16,}", "pypi-"),
    ("JWT", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{5,}\.[A-Za-z0-9_-]{5,}\.[A-Za-z0-9_-]{5,}", "eyJ"),
    ("PRIVATE_KEY", r"-----(BEGIN|END) [A-Z ]{0,40}PRIVATE KEY-----", "PRIVATE KEY"),
    ("DB_CONNECTION_STRING", r"(?<![A-Za-z])(?:postgres(?:ql)?|mysql|mariadb|mongodb(?:\+srv)?|redis|amqp)://[^\s:@/]+:[^\s@/]+@[^\s'\"]+", "://"),
    ("PASSWORD", r"(?<![A-Za-z])https?://([^\s:@/]+:[^\s@/]+)@", "://"),
    ("GENERIC_SECRET", r"(?i)(?<![A-Za-z0-9])(?:password|passwd|pwd|secret|token|api_key|apikey|access_key|secret_key)\s{0,3}[:=]\s{0,3}[\"']?([A-Za-z0-9+/_.~-]{8,}={0,2})", "password", "passwd", "pwd", "secret", "token", "api_key", "apikey", "access_key"),
)
IDENTIFIERS = (
    ("JP_PASSPORT_NUMBER", r"(?<![A-Za-z0-9])[A-Z]{2}\d{7}(?![A-Za-z0-9])", ("旅券", "パスポート", "passport", "旅券番号"), "prose_identifier", 0.9),
    ("JP_DRIVER_LICENSE_NUMBER", r"(?<!\d)\d{12}(?!\d)", ("運転免許", "免許証", "免許番号", "driver", "運転免許証番号"), "numeric", 0.9),
    ("JP_PENSION_NUMBER", r"(?<!\d)\d{4}[- ]?\d{6}(?!\d)", ("基礎年金", "年金番号", "年金手帳", "厚生年金", "国民年金"), "numeric", 0.9),
    ("JP_EMPLOYMENT_INSURANCE_NUMBER", r"(?<!\d)\d{4}[- ]?\d{6}[- ]?\d(?!\d)", ("雇用保険", "被保険者番号", "ハローワーク", "失業保険"), "numeric", 0.9),
    ("JP_HEALTH_INSURANCE_NUMBER", r"(?<!\w)\d{1,8}[- ]?\d{1,7}(?!\w)", ("健康保険", "保険証", "被保険者証", "記号番号", "健保"), "numeric", 0.85),
    ("JP_BANK_ACCOUNT", r"(?<!\d)\d{7}(?!\d)", ("口座番号", "口座", "普通預金", "当座", "振込先", "支店"), "numeric", 0.85),
)


def built_in(corporate: bool = False) -> list[Rule]:
    """The rules in the order in which detectors run."""
    out = [Rule("secret_patterns", entity, pattern, 0.95, 220, "environment_reference", "env_reference", hints=tuple(hints), group=int("(" in re.sub(r"\\.|\(\?", "", pattern)) if entity != "PRIVATE_KEY" else 0, extra={"finder": "blocks"} if entity == "PRIVATE_KEY" else {}) for entity, pattern, *hints in SECRETS]
    out += [
        Rule("formats", "EMAIL", DOMAIN, 0.95, 180, "email", "literal", hints=("@",), extra={"finder": "email"}),
        Rule("formats", "IP_ADDRESS", IPV4, 0.8, 165, "ipv4", "literal", check="ipv4"),
        Rule("formats", "CREDIT_CARD", CARD, 0.9, 205, "numeric", "block", check="luhn"),
        Rule("jp_my_number", "JP_MY_NUMBER", r"(?<!\d)\d{4}[ -]?\d{4}[ -]?\d{4}(?!\d)", 0.5, 210, "numeric", "block", check="my_number", words=MY_NUMBER_WORDS, near=0.95),
    ]
    out += [Rule("jp_phone", "PHONE", p, 0.55, 160, "numeric", "literal", words=PHONE_WORDS, near=0.9, needs="words or mark", mark="[- （）()+]") for p in PHONES]
    out += [
        Rule("jp_phone", "PHONE", r"内線[ ]?\d{1,5}", 0.9, 160, "numeric", "literal", words=PHONE_WORDS, needs="words"),
        Rule("jp_postal_code", "JP_POSTAL_CODE", r"\d{3}-\d{4}", 0.85, 160, "numeric", "literal", words=("〒", "郵便番号", "郵便"), needs="words", after=PREFECTURES, hints=("〒", "郵便", *PREFECTURES)),
        Rule("jp_address", "JP_ADDRESS", ADDRESS, 0.75, 170, "prose_identifier", "literal", words=("住所", "所在地", "送付先", "宛先", "居住地"), window=8, near=0.9, hints=PREFECTURES),
    ]
    out += [Rule("date_of_birth", "DATE_OF_BIRTH", p, 0.85, 155, "prose_identifier", "literal", words=BIRTH_WORDS, window=12, needs="words") for p in BIRTHS]
    residence = ("在留カード", "在留", "特別永住", "residence card", "在留資格")
    out.append(Rule("jp_identifiers", "JP_RESIDENCE_CARD", r"(?<![A-Za-z0-9])[A-Z]{2}\d{8}[A-Z]{2}(?![A-Za-z0-9])", 0.95, 208, "prose_identifier", "literal", check="residence_card", words=residence, needs="words"))
    out += [Rule("jp_identifiers", e, p, score, 206, profile, "literal", words=w, needs="words") for e, p, w, profile, score in IDENTIFIERS]
    if corporate:
        out.append(Rule("jp_corporate_number", "JP_CORPORATE_NUMBER", r"(?<![0-9A-Za-z])T?(\d{13})(?![0-9])", 0.9, 205, "numeric", "literal", check="corporate_number", words=(*CORPORATE_WORDS, "T"), needs="words", group=1))
    return out


def lint(pattern: str) -> str | None:
    """Why a user's pattern is refused, or None: nested unbounded repeats, repeated alternations, huge repeats."""
    try:
        re.compile(pattern)
    except re.error as e:
        return f"not a pattern: {e}"
    if re.search(r"\((?:\?:)?[^()]*[*+][^()]*\)(?:[*+]|\{\d+,\})", pattern):
        return "a repeat without bound inside another"
    if re.search(r"\((?:\?:)?[^()]*\|[^()]*\)(?:[*+]|\{\d+,\})", pattern):
        return "a repeated alternation"
    if any(int(n) > 1000 for n in re.findall(r"\{(?:\d+,)?(\d+)", pattern)):
        return "a repeat of more than 1000"
    return None


def user_rule(name: str, pattern: str, entity: str, *, score: float = 0.8, priority: int = 150, profile: str = "prose_identifier", policy: str = "literal", group: int = 0) -> Rule:
    if why := lint(pattern):
        raise ValueError(f"rule {name}: {why}")
    if policy not in STRENGTH or profile not in PROFILES or not 0 <= priority <= 1000 or not 0 <= score <= 1 or not 0 <= group <= re.compile(pattern).groups:
        raise ValueError(f"rule {name}: policy, profile, priority, score or group out of range")
    return Rule("user_regex", entity, pattern, score, priority, profile, policy, group=group)


def dictionary_rules(
    terms: dict[str, list[str]], *, spaced: bool = True, ignore_case: bool = False, priority: int = 100, policy: str = "literal", profile: str = "prose_identifier", env: dict[str, str] | None = None
) -> list[Terms]:
    """Entity -> values; values of ideographs alone also match with one blank between characters. ``env`` names, for an
    entity, a variable of the driver's environment that holds further values, one a line."""
    out = []
    for entity in {**terms, **(env or {})}:
        values = list(terms.get(entity, ()))
        if env and entity in env:
            if env[entity] not in os.environ:
                raise ValueError(f"{entity}: the variable {env[entity]} is not set")
            values += os.environ[env[entity]].splitlines()
        values = [unicodedata.normalize("NFKC", v) for v in values]
        if not values or any(not v.strip() for v in values) or len(set(values)) < len(values):
            raise ValueError(f"{entity}: no, blank or repeated values")
        if policy not in STRENGTH or profile not in PROFILES or not 0 <= priority <= 1000:
            raise ValueError(f"{entity}: policy, profile or priority out of range")
        out.append(Terms(entity, tuple(values), priority, policy, profile, ignore_case, spaced))
    return out


def durations(text: str) -> int:
    """Seconds of a duration like 30s, 15m, 4h or 1d."""
    found = re.fullmatch(r"(\d+)([smhd])", text)
    if not found:
        raise ValueError(f"no duration: {text}")
    return int(found[1]) * {"s": 1, "m": 60, "h": 3600, "d": 86400}[found[2]]


def load_config(text: str) -> tuple[list[Rule | Terms], dict]:
    """Rules and settings of a configuration in JSON: version 1; ``entities`` (id, type, values or env, case_insensitive,
    priority, policy, profile), ``patterns`` (id, type, pattern, group, score, priority, policy, profile), ``session`` (idle_ttl, absolute_ttl),
    ``corporate_number``. Unknown names, repeated ids and an idle time above the absolute one are errors."""
    try:
        found = json.loads(text)
    except ValueError:
        import yaml  # only where the configuration isn't JSON

        found = yaml.safe_load(text)

    def only(row: dict, what: str, *names: str) -> dict:
        if not isinstance(row, dict) or set(row) - set(names):
            raise ValueError(f"{what}: unknown names {sorted(set(row) - set(names))}" if isinstance(row, dict) else f"{what}: not a table")
        return row

    only(found, "configuration", "version", "entities", "patterns", "session", "corporate_number")
    if found.get("version") != 1:
        raise ValueError("the version must be 1")
    entities = [only(e, "entities", "id", "type", "values", "env", "case_insensitive", "priority", "policy", "profile") for e in found.get("entities", [])]
    patterns = [only(e, "patterns", "id", "type", "pattern", "group", "score", "priority", "policy", "profile") for e in found.get("patterns", [])]
    ids = [e["id"] for e in (*entities, *patterns)]
    if len(set(ids)) < len(ids):
        raise ValueError("ids must differ")
    out: list[Rule | Terms] = built_in(corporate=bool(found.get("corporate_number")))
    for e in entities:
        some = {k: e[k] for k in ("priority", "policy", "profile") if k in e}
        out += dictionary_rules({e["type"]: e.get("values", [])}, env={e["type"]: e["env"]} if "env" in e else None, ignore_case=bool(e.get("case_insensitive")), **some)
    for e in patterns:
        out.append(user_rule(e["id"], e["pattern"], e["type"], **{k: e[k] for k in ("group", "score", "priority", "policy", "profile") if k in e}))
    session = only(found.get("session", {}), "session", "idle_ttl", "absolute_ttl")
    idle, absolute = durations(session.get("idle_ttl", "4h")), durations(session.get("absolute_ttl", "24h"))
    if idle > absolute:
        raise ValueError("the idle time exceeds the absolute time")
    return out, {"idle_seconds": idle, "absolute_seconds": absolute}
