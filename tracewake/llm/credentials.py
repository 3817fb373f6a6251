"""Credentials embedded in source code (problem 6).

Lines yield candidates: a value with the identifier or words that introduce it,
how it was introduced and the file it stands in. Values come from literals and
assignments beside account words, from URLs, headers, commands and prose, and,
wherever they stand, from tokens of random shape. A logistic regression scores each
candidate from the likelihood ratio of its characters under two Markov chains
(secret values against ordinary code words), from its shape, the words around it,
the words inside it and the path. It is trained on weak labels: patterns that are
nearly always credentials or nearly never. A pattern's own evidence is hidden from
the features of the rows that it labels (an issued prefix is cut off, the words of an
identifier are left out of every other copy), so the model learns the rest. Scores
are calibrated by Platt scaling on a held-out part; values at or above THRESHOLD are
redacted in place, so quotes, users, hosts and the code around stay as they are.

The fit uses about TRAIN_TASKS tasks (those whose id hashes lowest) and at most
TRAIN_CANDIDATES of their candidates and TRAIN_WORDS ordinary words, with a fixed set
of made-up examples so that tiny tables train too. Scoring covers every line of
every text and values of any length.

Nulls and edge cases: null ids and texts give nothing; lines are split at line
feeds only and counted from 1; of a redelivered id the list takes the lines of all
deliveries and the redacted table the first one; the body of a private key is redacted with its
first line, up to its END line or to the first line that can't belong to it; empty
tables give no rows.
"""

from __future__ import annotations

import base64
import binascii
import random
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewake.llm import sparse
from tracewake.session import cut, spread

TRAIN_TASKS = 3000
TRAIN_CANDIDATES = 20_000
TRAIN_WORDS = 5000
THRESHOLD = 0.5
SEED = 7

# fixed values: public prefixes of issued keys and tokens, and what follows them
PREFIXES = (
    *((p, r"[A-Z0-9]{16}\b") for p in ("AKIA", "ASIA")), *((p, r"[A-Za-z0-9]{20,}") for p in ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")), ("glpat-", r"[\w-]{16,}"),
    *((p, r"[\w-]{10,}") for p in ("xoxa-", "xoxb-", "xoxr-", "xoxp-", "xoxs-")), *((p, r"\w{16,}") for p in ("sk_live_", "sk_test_")), ("sk-", r"[\w-]{20,}"), ("AIza", r"[\w-]{30,}"), ("eyJ", r"[\w-]{8,}\.[\w-]{8,}\.[\w-]{8,}"),
)
PREFIXED = "|".join(p + rest for p, rest in PREFIXES)
# fixed values: words of an account, before its user and password
ACCOUNT_WORDS = ("login", "logon", "log-in", "log in", "signin", "sign-in", "sign in", "account", "user", "anmeldung", "zugang", "usuario", "登录", "账号", "账户", "用户")
ACCOUNT = r"(?P<c>(?<![A-Za-z])(?:" + "|".join(ACCOUNT_WORDS) + r")(?:s|name|names)?(?![A-Za-z0-9_]))"
# a value that no identifier looks like: small letters, digits and capitals or signs
SHAPED = r"(?<![^\s'\"`(=:,])(?!(?i:sha\d|md5|urn:))(?!_?(?:[A-Z]?[a-z]{2,}+|[A-Z]{2,}+|[vV]?\d++|[_-])++(?![\w!#$%^&*+=~-]))(?=[^\s'\"`]*[a-z])(?=[^\s'\"`]*\d)(?=[^\s'\"`]*[A-Z!#$%^&*])(?P<v>[\w!#$%^&*+=~-]{8,})(?![^\s'\"`),;.])"
IDENT = r"(?<![\w.$-])(?=[\w.$-]*?(?:pass(?:word|wd|phrase|code|wort)?|pwd|pw|secrets?|tokens?|keys?|credentials?|creds?|auth|kennwort|contraseña|密码|口令|密钥))[\w.$-]++"

PEM = re.compile(r"-----\s*BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?\s*-----", re.I)
PEM_END = re.compile(r"-----\s*END (?:[A-Z0-9]+ )*PRIVATE KEY", re.I)
INLINE_BODY = re.compile(r"(?<=\\n)[A-Za-z0-9+/=]+|(?<![A-Za-z0-9+/=\\])[A-Za-z0-9+/=]{24,}")
BODY_LINE = re.compile(r"(?m)^([+\- ]?[ \t]*[\"']?)[A-Za-z0-9+/=]{2,}(?!:)")
OF_BODY = re.compile(r"[+\- ]?[ \t]*[\"']?([A-Za-z0-9+/=]*)(?:\\n)?[\"'+, ]*\r?")
PEM_HEADER = re.compile(r"[+\- ]?[ \t]*[\"']?(?:Proc-Type|DEK-Info|Version|Comment): ", re.I)
FORMS: tuple[tuple[str, re.Pattern[str]], ...] = (
    ("url", re.compile(r"(?P<c>\b[a-z][a-z0-9+.-]*)\s?:\s?//[^\s:/@'\"]*:(?P<v>[^\s@/'\"]+)@", re.I)),
    ("header", re.compile(r"(?P<c>authorization['\"]?\s*[:=,]\s*['\"]?(?:bearer|basic|token)|x-[\w-]*(?:key|token|secret|auth)[\w-]*['\"]?\s*[:=,])\s*['\"]?(?P<v>[^\s'\",;]+)", re.I)),
    ("command", re.compile(r"(?P<c>\b\w*PASSWORD\s*=|\bsshpass\s+-p|\s--(?:password|token|secret|api-key)[ =]|\bcurl\b(?:(?!\bcurl\b).)*?\s(?:-u|--user)[\s=]+['\"]?[^\s:'\"]+:|\bmysql\w*\b(?:(?!\bmysql).)*?\s-p(?=\S))\s*['\"]?(?P<v>[^\s'\"]+)")),
    ("sql", re.compile(r"(?P<c>\b(?:identified\s+by|with\s+password|encrypted\s+password|password))\s+'(?P<v>[^']+)'", re.I)),
    ("prose", re.compile(r"(?P<c>\b(?:password|passwd|passphrase|pwd|token|secret|api key|passwort|kennwort|contraseña)\s+(?:is|was|ist|es|war)|密码[是为：:]|口令[是为：:])\s*:?\s*['\"`]?(?P<v>[^\s'\"`]+)", re.I)),
    ("encoded", re.compile(r"(?P<c>\b(?:\w*decode\w*|b64\w*|from_?base64)\s*)\(\s*['\"](?P<v>[A-Za-z0-9+/_-]{6,}={0,2})['\"]", re.I)),
    ("call", re.compile(r"(?P<c>" + IDENT + r")\s*\(\s*(?P<q>['\"])(?P<v>[^'\"]+)(?P=q)", re.I)),
    ("pair", re.compile(r"['\"](?P<c>" + IDENT + r")['\"]\s*,\s*(?P<q>['\"`])(?P<v>[^'\"`]+)(?P=q)", re.I)),
    ("quoted", re.compile(r"(?P<c>" + IDENT + r")['\"]?\]?(?:\s*:\s*\w+)?\s*(?::\s?=|=\s?>|=|:)\s*(?P<q>['\"`])(?P<v>[^'\"`]+)(?P=q)", re.I)),
    ("bare", re.compile(r"(?P<c>" + IDENT + r")\s*(?::\s?=|=|:)\s*(?P<v>[^\s'\"`,;(){}\[\]]+)\s*;?\s*(?:[#/].*)?$", re.I)),
    ("field", re.compile(r"(?<![\w.$-])(?P<c>" + IDENT + r")=(?P<v>[^\s'\"`;&,<>(){}\[\]]{6,})", re.I)),
    ("phrase", re.compile(r"^[+\- ]?\s*[\"']?(?P<c>" + IDENT + r")[\"']?\s*[:=]\s+(?P<v>[^\W\d_]{3,}(?: [^\W\d_]{3,}){2,})\s*$", re.I)),
    ("prefixed", re.compile(r"(?P<c>)(?<![A-Za-z0-9])(?P<v>" + PREFIXED + ")")),
)
#: the part of a login line behind the account's words
LOGIN_TAIL = re.compile(r"(?:\s(?:was|is|were|are|ist|war|es|era|with|as)\s*:?|[:=：]|[是为])\s*['\"`(]?(?![\d/])[\w.@+-]++['\"`]?\s+[/|]\s+['\"`]?(?P<v>[^\s'\"`]+)", re.I)
LOGIN_SHAPED = re.compile(SHAPED)
NO_LOGIN = re.compile(r"\b(?:u?u?ids?|hash|commit|checksum|digest|sha\d*|md5|etag|fingerprint|public)\b", re.I)
ACCOUNT_WORD = re.compile(ACCOUNT, re.I)
#: tokens anywhere that may be random, and the runs inside them
TOKEN = re.compile(r"(?<![A-Za-z0-9_~+/=.-])[A-Za-z0-9_~+/=.-]{16,}")
RUN = re.compile(r"[A-Za-z0-9+]{14,}")
TURNS = re.compile(r"[A-Za-z](?=\d)|\d(?=[A-Za-z])")
WORD_IN_RUN = re.compile(r"[A-Z]?[a-z]{3,}|[A-Z]{4,}")
HEX = re.compile(r"[0-9a-fA-F]+")
INTRODUCED = re.compile(r"[^\W_]+")
KINDS = ("pem", *dict.fromkeys(k for k, _ in FORMS), "login", "token")
#: form: words of which each line that it fits holds one; ident stands for the forms with an identifier
WORDS_OF = {
    "pem": ("private key",),
    "url": ("://",),
    "header": ("auth", "key", "token", "secret"),
    "command": ("password", "sshpass", "token", "secret", "api-key", "curl", "mysql"),
    "sql": ("identified", "password"),
    "prose": ("pass", "pwd", "token", "secret", "api key", "passwort", "kennwort", "contraseña", "密码", "口令"),
    "encoded": ("decode", "b64", "base64"),
    "ident": ("pass", "pwd", "pw", "secret", "token", "key", "cred", "auth", "kennwort", "contraseña", "密码", "口令", "密钥"),
    "prefixed": tuple(p.lower() for p, _ in PREFIXES),
    "login": ACCOUNT_WORDS,
}
TRIGGERS = tuple(sorted({w for words in WORDS_OF.values() for w in words}))

PREFIX = re.compile(PREFIXED)
ISSUED = re.compile("|".join(re.escape(p) for p, _ in PREFIXES) + r"|[A-Za-z]{2,6}[_.-](?=[A-Za-z0-9_.-]{16})")
NOT_SECRET = re.compile(r"sha\d+|integrity|checksum|etag|md5|digest|commit|fingerprint|ssh-|public|uuid|\bid\b|hash|index|revision|signature", re.I)
FUNCTION_WORD = re.compile(r"\b(?:the|an?|is|are|be|must|not|to|of|in|for|and|or|with|from|should|may|can|your|this|that|it|if|when|see|use|no|der|die|das|und|nicht|el|la|los|de|no|que)\b", re.I)
PLACEHOLDER = re.compile(
    r"^(?:[*x.•_-]{3,}|<.*>?|\.\.\.|\[.*\]?|(?:your|my|some|the)[-_ ].*|.*(?:change[-_ ]?me|placeholder|redacted|replace[-_ ]?me|to[-_ ]?do|-here>?|dummy|example[-_ ]?(?:key|token|secret|pass)).*|null|none|nil|undefined|true|false|string|test|todo|required|optional|0+|1+)$",
    re.I,
)
VARIABLE = re.compile(r"^(?:\$.*|%.*%|%[sdv]|\{\{.*|\$?\{.*\}?|@\w+@|#\{.*|:\w+|\?|&\w+)$|os\.environ|getenv|process\.env|System\.|viper\.|config\.|settings\.|vault|ENV\[|secrets\.|params\.|args\.", re.I)
STRONG = re.compile(r"pass(?!age|ive|enger|ed\b|es\b|ing)|pwd|\bpw\b|_pw\b|pw$|secret|token|api_?-?key|access_?-?key|sign(?:ing)?_?-?key|private_?-?key|encrypt(?:ion)?_?-?key|credential|密码|口令|密钥|kennwort|contraseña|authorization|x-[\w-]*key", re.I)
WEAK = re.compile(r"key|auth|cred", re.I)
COUNTER = re.compile(
    r"(?:public|pub|cache|primary|foreign|sort|row|partition|map|object|route|hash|index|group|lookup|idempotency)_?-?\.?key|sha\d*|checksum|etag|md5|digest$|commit|fingerprint|integrity|min_?-?length|max_?-?length|length$|limit$|count$|ttl$|timeout|expir|policy$|type$|name$|path$|file$|field$|url$|uri$|_id$|header$|enabled$|hint$|regex|pattern|tokeni[sz]",
    re.I,
)
WORDS = re.compile(r"^(?:[a-z]+|[A-Z]+|[A-Z]?[a-z]+(?:[A-Z][a-z]{2,})+|[A-Z][a-z]+)(?:[._ -](?:[a-z]+|[A-Z]+|[A-Z][a-z]+))*$")
CALLS = re.compile(r"[\w.]+\(.*|.*\)$")
CODE_PATH = re.compile(r"\.(?:go|py|java|ts|js|kt|rb|c|cc|cpp|rs|sh|sql)$", re.I)
CONFIG_PATH = re.compile(r"\.(?:ya?ml|json|env|properties|toml|ini|conf|cfg|xml)$", re.I)
TEST_PATH = re.compile(r"(?:^|/)(?:tests?|spec|fixtures?|examples?|docs?|samples?)/|_test\.|\.md$", re.I)
JOINED = re.compile(r"(['\"])\s*\+\s*\1")
FILE_LINE = re.compile(r"^(?:\+\+\+ (?:b/)?|diff --git a/)(\S+)", re.I | re.M)
AT = re.compile(r"[^\s@/'\"]*+@")
PLAIN = re.compile(r"[A-Za-z_][\w./-]{3,}")
ENCODED = re.compile("b64|base64|decode", re.I)
B64 = re.compile(r"^[A-Za-z0-9+/_-]{6,}={0,2}$")


@dataclass(frozen=True)
class Candidate:
    kind: str
    context: str
    value: str
    path: str


def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for t in TRIGGERS:
        a.add_word(t, len(t))
    a.make_automaton()
    return a


def random_tokens(text: str) -> list[int]:
    """Positions of tokens with a run of letters and digits that alternate, unless it is all hexadecimal."""
    return [m.start() for m in TOKEN.finditer(text) if _random_run(m.group())]


def _random_run(token: str) -> str | None:
    best = None
    for r in RUN.findall(token):
        if len(TURNS.findall(r)) > 2 and not HEX.fullmatch(r) and sum(map(len, WORD_IN_RUN.findall(r))) < 0.4 * len(r) and (best is None or len(r) > len(best)):
            best = r
    return best


def trigger_lines(text: str, automaton: ahocorasick.Automaton) -> list[tuple[int, int, int]]:
    """(line number, start, end) of the lines that hold a trigger word or a token of random shape."""
    low = text.lower()
    if len(low) != len(text):  # a few letters change their length
        low = "".join(c if len(k := c.lower()) != 1 else k for c in text)
    places = [pos for pos, word in automaton.iter(low) if not (word == 3 and low[pos - 2 : pos + 1] == "://" and not AT.match(low, pos + 1))]
    out, no, at, end = [], 1, 0, -1
    for pos in sorted(places + random_tokens(text)):
        if pos < end:
            continue
        begin = text.rfind("\n", 0, pos) + 1
        no += text.count("\n", at, begin)
        at = begin
        end = text.find("\n", pos)
        end = len(text) if end < 0 else end
        out.append((no, begin, end))
    return out


def _is_header(text: str, a: int, b: int) -> bool:
    """Whether the line from a to b is a file header: diff --git, or a line of --- directly before one of +++."""
    if text.startswith("--- ", a):
        return text.startswith("+++ ", b + 1)
    if text.startswith("+++ ", a):
        return a > 0 and text.startswith("--- ", text.rfind("\n", 0, a - 1) + 1)
    return text[a : a + 11].lower() == "diff --git "


def candidates(line: str) -> list[tuple[str, str, str]]:
    """(kind, context, value) of one line; the first form that finds a value keeps it."""
    if PEM.search(line):
        return [("pem", "private key", "BEGIN PRIVATE KEY")]
    whole = JOINED.sub("", line)
    tail = m.group(0) if (m := re.search(r"(?://|#|--)\s.*$", whole)) else ""
    out: list[tuple[str, str, str]] = []
    seen: set[str] = set()

    def add(kind: str, context: str, v: str) -> None:
        v = v.rstrip("\r;,")
        if kind in ("prose", "login"):
            v = v.rstrip(".,)")
        if v not in seen and any(x.isalnum() or x in "*•" for x in v):
            seen.add(v)
            out.append((kind, context, v))

    for kind, form in FORMS:
        for m in form.finditer(whole):
            add(kind, m.group("c") + (" " + tail if kind == "encoded" else ""), m.group("v"))
    accounts = [m.start() for m in ACCOUNT_WORD.finditer(whole)]
    if accounts:
        for m in LOGIN_TAIL.finditer(whole):
            if accounts[0] < m.start():
                add("login", "login", m.group("v"))
        barred = [m.start() for m in NO_LOGIN.finditer(whole)]
        for m in LOGIN_SHAPED.finditer(whole):
            k = bisect_right(accounts, m.start("v")) - 1
            if k >= 0 and bisect_right(barred, m.start("v")) == bisect_right(barred, accounts[k]):
                add("login", "login", m.group("v"))
    if not OF_BODY.fullmatch(line):  # lines of keys and certificates hold nothing but themselves
        for m in TOKEN.finditer(whole):
            if (v := _random_run(m.group())) and not any(v in x or x in m.group() for x in seen):
                before = INTRODUCED.findall(whole[: m.start()])[-4:]
                inside = [w for w in INTRODUCED.findall(m.group()[: m.group().index(v)]) if (w.isalpha() and len(w) < 13 or len(w) < 8) and (w.islower() or w.isupper() or w.istitle())]
                in_path = "/" in m.group() and (whole[: m.start()].endswith(":") or "." in m.group()) or "=" in m.group().rstrip("=")
                add("token", " ".join(before + inside), v if in_path else m.group())
    return out


def _clear(value: str) -> str:
    """The text behind a base64 value, if it is printable; else the value."""
    if not B64.match(value) or len(value) % 4 == 1:
        return value
    try:
        t = base64.b64decode(value + "=" * (-len(value) % 4), validate=True).decode("ascii")
    except (binascii.Error, ValueError, UnicodeDecodeError):
        return value
    return t if t.isprintable() and len(t) >= 4 else value


class Markov:
    """First-order character chains of secrets and of ordinary words."""

    SIZE = 96

    def __init__(self, secret: list[str], plain: list[str]):
        self.ratio = np.log(self._chain(secret)) - np.log(self._chain(plain))

    @classmethod
    def _codes(cls, s: str) -> np.ndarray:
        b = np.frombuffer(s.encode("latin-1", "replace"), np.uint8).astype(np.int64)
        return np.where((b >= 32) & (b < 127), b - 31, 0)

    @classmethod
    def _chain(cls, words: list[str]) -> np.ndarray:
        n = np.ones((cls.SIZE, cls.SIZE))
        for w in words:
            c = cls._codes(w)
            np.add.at(n, (np.concatenate(([0], c[:-1])), c), 1.0)
        return n / n.sum(axis=1, keepdims=True)

    def score(self, s: str) -> float:
        c = self._codes(s)
        return float(self.ratio[np.concatenate(([0], c[:-1])), c].mean()) if len(c) else 0.0


_SPLIT = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-zß-ÿ]+|[\u4e00-\u9fff]+")


def words_of(s: str) -> list[str]:
    """The words of an identifier or phrase, in small letters."""
    return [w.lower() for w in _SPLIT.findall(s)]


def features(c: Candidate, chain: Markov, context: bool = True) -> list[str]:
    """Shape, likelihood, words around and inside, path. An issued prefix is no evidence: it labels rows."""
    v = c.value
    bare = ISSUED.sub("", v, count=1) if ISSUED.match(v) else v
    clear = _clear(v) if c.kind in ("header", "encoded") or v[-1] == "=" or ENCODED.search(c.context) else bare
    n = len(bare)
    classes = "".join(k for k, hit in zip("aA0", (any(x.islower() for x in bare), any(x.isupper() for x in bare), any(x.isdigit() for x in bare)), strict=True) if hit)
    signs = sorted({x for x in v if not x.isalnum()})
    inner = [w for w in words_of(bare) if len(w) > 2]
    covered = sum(map(len, inner)) / max(n, 1)
    score = chain.score(bare)
    out = [
        "bias", f"kind:{c.kind}", f"chain:{max(-6, min(6, round(score * 3)))}", f"chain:{c.kind}:{max(-3, min(3, round(score)))}", f"clear:{max(-4, min(4, round(chain.score(clear) * 2)))}",
        f"length:{min(n, 48) // 4}", f"classes:{classes}", f"variety:{round(8 * len(set(bare)) / max(n, 1))}", f"digits:{round(6 * sum(x.isdigit() for x in bare) / max(n, 1))}",
        f"covered:{round(4 * covered)}", f"first:{v[0] if not v[0].isalnum() else 'x'}", f"last:{v[-1] if not v[-1].isalnum() else 'x'}", *(f"sign:{x}" for x in signs[:8]),
        *(f"inside:{w}" for w in inner[:8]), f"number:{v.isdigit()}", f"one:{len(set(v.lower()) - set('-_ .')) <= 2}", f"words:{min(v.count(' '), 4)}", f"stop:{bool(FUNCTION_WORD.search(v)) and ' ' in v}",
    ]
    if clear != bare:
        out.append("decodes")
    if HEX.fullmatch(bare):
        out.append(f"hex:{n if n in (7, 8, 32, 40, 64) else 'other'}")
    ext = c.path.rsplit(".", 1)[-1].lower() if "." in c.path else ""
    out += [f"ext:{ext}", f"test:{bool(TEST_PATH.search(c.path))}"]
    if context:
        around = [w for w in words_of(c.context) if len(w) > 1]
        out += [f"around:{w}" for w in around] + [f"holds:{w}" for w in WORDS_OF["ident"] if w in c.context.lower()] + [f"last_word:{around[-1] if around else ''}", *(f"pair:{a} {b}" for a, b in zip(around, around[1:], strict=False))]
    else:
        out.append("no context")
    return out


def weak_label(c: Candidate) -> int | None:
    """1 or 0 where a pattern is nearly sure, None elsewhere."""
    v = c.value
    if c.kind == "pem" or PREFIX.match(v):
        return 1
    if c.kind == "phrase":
        return int(not FUNCTION_WORD.search(v)) if re.search("pass|kennwort|contraseña|密码", c.context, re.I) else None
    if PLACEHOLDER.match(v) or VARIABLE.search(v) or COUNTER.search(c.context) or " " in v or CALLS.match(v) or v.replace(".", "").isdigit() or WORDS.match(v):
        return 0
    if c.kind == "token":
        return 0 if NOT_SECRET.search(c.context) else None
    if len(v) >= 6 and c.kind in ("url", "header", "command", "sql", "prose", "login"):
        return 1
    if len(v) >= 6 and c.kind in ("quoted", "call", "pair", "bare", "encoded", "field") and STRONG.search(c.context):
        return 1
    return None


def made_up_examples() -> list[tuple[Candidate, int]]:
    """A fixed set with labels from a seeded generator, so that every form has both labels."""
    r = random.Random(SEED)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    words = ("north", "river", "amber", "stone", "cloud", "maple", "ember", "quiet", "velvet", "copper", "walnut", "harvest")
    usual = "read write open close admin root user name value default field input check valid empty local main test prod stage order items count index start stop list view edit done error".split()
    plain = lambda: r.choice(usual) if r.random() < 0.5 else "".join(r.choice("bdfglmnprst") + r.choice("aeiou") for _ in range(r.randint(2, 3)))
    contexts = {"url": ("postgres", "amqp", "redis"), "header": ("Authorization: Bearer", "X-Api-Key:"), "command": ("PGPASSWORD=", "sshpass -p", "--token"), "sql": ("identified by", "with password"), "prose": ("password is", "token was"), "login": ("login",)}
    idents = ("password", "api_key", "authToken", "SECRET", "db_pw", "clientSecret", "ADMIN_PASS", "signing.key", "accessToken", "credential")
    harmless = ("tokenLimit", "passwordMinLength", "cacheKey", "keyTimeout", "secretName", "primaryKey", "tokenType", "passwordHint", "keyPath", "authEnabled")
    out: list[tuple[Candidate, int]] = []
    for k in range(840):
        kind = KINDS[k % len(KINDS)]
        path = r.choice(("svc/app.go", "conf/app.yaml", "job/run.py", "web/app.ts", "src/App.java", "db/init.sql", "app.properties", ".env", ""))
        token = "".join(r.choice(letters) for _ in range(r.choice((20, 24, 32, 43))))
        value = "".join(r.choice((letters[:52], letters, letters + "+/")[k // len(KINDS) % 3]) for _ in range(r.choice((10, 12, 14, 20, 32, 40))))
        phrase = f"{r.choice(words)}-{r.choice(words)}-{r.randint(10, 99)}"
        title = f"{r.choice(words).title()}{r.randint(100, 9999)}{r.choice('!#*%$')}"
        context = r.choice(contexts.get(kind, idents))
        empty = r.choice(("${APP_VALUE}", f"${{{plain().upper()}_{plain().upper()}}}", "$TOKEN", "********", "<your-token-here>", "xxxxxxxxxxxxxxxx", "{{ vault.app }}", "%s", "null", "changeme", f'os.environ["{plain().upper()}"]', f"cfg.{plain().title()}()"))
        if kind == "pem":
            out.append((Candidate(kind, "private key", "BEGIN PRIVATE KEY", path), 1))
        elif kind == "token":
            for _ in range(6):
                token = "".join(r.choice(letters) for _ in range(r.choice((16, 20, 24, 32, 43))))
                issued = r.choice(("ghp_", "glpat-", "sk_live_", "xoxb-", "npm_", "SG.", "pk-", "rk_", "dop_v1_", "", ""))
                around = " ".join(r.choice((plain(), "hooks", "services", "export", "const", "client", "url", "old", "config", "k", "x", "send", "T", "uses")) for _ in range(r.randint(0, 4)))
                out.append((Candidate(kind, around, issued + (token if r.random() < 0.7 else f"{token[:9]}{r.choice('.-_')}{token[9:]}x"), path), 1))
                digest = " ".join(r.sample(("sha1", "sha256", "sha512", "integrity", "ssh", "rsa", "ed25519", "public key", "etag", "commit", "checksum", "hash", "digest", "fingerprint", "build id", "request id", "revision", "signature"), 2))
                hashed = "".join(r.choice(letters + r.choice(("", "+/"))) for _ in range(r.choice((27, 43, 68, 86))))
                out.append((Candidate(kind, f"{plain()} {digest}" if r.random() < 0.5 else digest, hashed + r.choice(("", "=", "==")), path), 0))
        elif kind == "phrase":
            for _ in range(3):
                out.append((Candidate(kind, r.choice(("password", "passphrase", "db_pass")), " ".join(r.choice((r.choice(words), plain())) for _ in range(r.choice((3, 4, 5)))), path), 1))
            out.append((Candidate(kind, r.choice(("password", "passphrase", "db_pass", "token")), r.choice(("must not be empty", "see the vault for this", "is read from the environment", "the password of the user", f"the {plain()} to use for {plain()}")), path), 0))
        else:
            out.append((Candidate(kind, context, r.choice((value, value, phrase, title)), path), 1))
            out.append((Candidate(kind, context, empty, path), 0))
            out.append((Candidate(kind, r.choice((context, *harmless)), plain() if r.random() < 0.5 else f"{plain()}{plain().title()}", path), 0))
            out.append((Candidate(r.choice(("bare", "field", "quoted", "call", kind)), r.choice(harmless), r.choice((str(r.randint(0, 10 ** r.randint(1, 5))), "user_id", f"{plain()}_{plain()}")), path), 0))
            if kind in ("pair", "quoted", "call", "bare", "encoded"):
                coded = base64.b64encode(r.choice((phrase, value, title)).encode()).decode()
                out.append((Candidate(kind, "decode // password" if kind == "encoded" else r.choice(("app.password.b64", "tokenBase64", "secret_b64")), coded, path), 1))
    return out


@dataclass
class Model:
    chain: Markov
    weights: dict[str, float]
    platt: tuple[float, float]

    def probability(self, candidates: list[Candidate]) -> list[float]:
        return [sparse.probability(self.platt[0] * sum(self.weights.get(f, 0.0) for f in features(c, self.chain)) + self.platt[1]) for c in candidates]


def train(rows: list[Candidate], plain: list[str]) -> Model:
    """Fits chains, weights and calibration from weakly labelled candidates, each with and without its context."""
    known = sorted({(*_tuple(c), y) for c, y in [*((c, weak_label(c)) for c in rows), *made_up_examples()] if y is not None})
    labelled = [(Candidate(*k[:4]), k[4]) for k in known]
    secret = [ISSUED.sub("", c.value, count=1) for c, y in labelled if y and c.kind not in ("pem", "phrase")]
    chain = Markov(secret, plain + [c.value for c, y in labelled if not y and c.kind != "token"])
    data = [(features(c, chain, context), y) for c, y in labelled for context in (True, False) if context or c.kind not in ("pem", "token")]
    weights, platt = sparse.fit(data)
    return Model(chain, weights, platt)


def _tuple(c: Candidate) -> tuple[str, str, str, str]:
    return c.kind, c.context, c.value, c.path


def lines_with_candidates(text: str, automaton: ahocorasick.Automaton) -> list[tuple[int, int, int, list[Candidate]]]:
    """(line number, start, end, candidates) of the lines that have any, with the file they belong to."""
    starts: list[int] | None = None
    names: list[str] = []
    out = []
    for no, a, b in trigger_lines(text, automaton):
        line = text[a:b]
        if _is_header(text, a, b):
            continue
        if found := candidates(line):
            if starts is None:
                heads = [(m.start(), m.group(1)) for m in FILE_LINE.finditer(text)]
                starts, names = [h[0] for h in heads], [h[1] for h in heads]
            k = bisect_right(starts, a) - 1
            out.append((no, a, b, [Candidate(kind, c, v, names[k] if k >= 0 else "") for kind, c, v in found]))
    return out


def fit(df: DataFrame, text: str = "input_diff", id_col: str = "id") -> Model:
    """Trains on about TRAIN_TASKS tasks; only candidates and some words reach the driver."""
    n = df.count()
    share = min(1.0, TRAIN_TASKS / max(n, 1))
    low = F.xxhash64(id_col, F.lit(SEED)) < F.lit(min(int(-(2**63) + share * (2**64 - 1)), 2**63 - 1))
    sample = df.where(F.col(text).isNotNull() & (low if share < 1 else F.lit(True))).select(F.col(text).alias("t"))

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a = _automaton()
        for batch in batches:
            rows = []
            for t in batch["t"]:
                for _, _, _, found in lines_with_candidates(t, a):
                    rows += [_tuple(c) for c in found]
                rows += [("plain", "", w, "") for w in PLAIN.findall(t)[:: max(1, t.count("\n") // 8)]]
            yield pd.DataFrame(rows, columns=["kind", "context", "value", "path"])

    rows = cut(spread(sample).mapInPandas(extract, "kind string, context string, value string, path string").distinct())
    some = rows.orderBy(F.xxhash64("kind", "context", "value", "path"))  # candidates and plain words have bounds of their own
    found = some.where("kind <> 'plain'").limit(TRAIN_CANDIDATES).collect()
    return train([Candidate(*r) for r in found], [r[2] for r in some.where("kind = 'plain'").limit(TRAIN_WORDS).collect()])


def found_in(text: str, model: Model, automaton: ahocorasick.Automaton) -> list[tuple[int, int, int, list[Candidate]]]:
    """Lines with at least one candidate scored at or above the threshold, and those candidates."""
    lines = lines_with_candidates(text, automaton)
    flat = [c for *_, found in lines for c in found]
    if not flat:
        return []
    p = model.probability(flat)
    out, k = [], 0
    for no, a, b, found in lines:
        good = [c for c, q in zip(found, p[k : k + len(found)], strict=True) if q >= THRESHOLD]
        k += len(found)
        if good:
            out.append((no, a, b, good))
    return out


def redact(text: str, hits: list[tuple[int, int, int, list[Candidate]]]) -> str:
    """The text with the values replaced; nothing else changes."""
    out, at = [], 0
    for _, a, b, good in hits:
        if a < at:
            continue
        out.append(text[at:a])
        line = text[a:b]
        at = b
        for c in good:
            if c.kind == "pem":
                m = PEM.search(line)
                if m and len(line) - m.end() > 24:  # the whole key as one string
                    line = line[: m.end()] + INLINE_BODY.sub("REDACTED_KEY", line[m.end() :])
                else:
                    end = _pem_end(text, b)
                    line += BODY_LINE.sub(r"\1REDACTED_KEY", text[b:end])
                    at = end
            elif c.value in line:
                line = line.replace(c.value, f"REDACTED_{c.kind.upper()}")
            else:  # a literal in two parts
                for m in reversed(list(re.finditer(r"(['\"])([^'\"]+)\1", line))):
                    if m.group(2) in c.value:
                        line = line[: m.start(2)] + f"REDACTED_{c.kind.upper()}" + line[m.end(2) :]
        out.append(line)
    return "".join(out) + text[at:]


def _pem_end(text: str, at: int) -> int:
    """End of the key's body that starts behind at; a short line belongs to it only before the END line."""
    while at < len(text):
        nxt = text.find("\n", at + 1)
        nxt = len(text) if nxt < 0 else nxt
        line = text[at + 1 : nxt]
        if PEM_END.search(line):
            return at
        if not PEM_HEADER.match(line):
            m = OF_BODY.fullmatch(line)
            after = text.find("\n", nxt + 1)
            if not m or (0 < len(m.group(1)) < 16 and not PEM_END.search(text[nxt + 1 : len(text) if after < 0 else after])):
                return at
        at = nxt
    return len(text)


def credential_lines(df: DataFrame, model: Model, text: str = "input_diff", id_col: str = "id") -> DataFrame:
    """task_id, line_no of every line that holds a credential."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a = _automaton()
        for batch in batches:
            rows = [(i, no) for i, t in zip(batch["id"], batch["t"], strict=True) for no, *_ in found_in(t, shared.value, a)]
            yield pd.DataFrame(rows, columns=["task_id", "line_no"])

    texts = df.where(F.col(text).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text).alias("t"))
    return spread(texts).mapInPandas(run, "task_id string, line_no int").distinct()


def redacted(df: DataFrame, model: Model, text: str = "input_diff", id_col: str = "id") -> DataFrame:
    """task_id, lines (number of lines with credentials), redacted, and the changed lines as they were; one row per id."""
    from tracewake.sources.tables import first_per_id

    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a = _automaton()
        for batch in batches:
            rows = []
            for i, t in zip(batch["id"], batch["t"], strict=True):
                hits = found_in(t, shared.value, a) if t is not None else []
                out = redact(t, hits) if hits else t
                changed = [{"line_no": k, "line": x} for k, (x, y) in enumerate(zip(t.split("\n"), out.split("\n"), strict=True), 1) if x != y] if hits else []
                rows.append((i, len(hits), out, changed))
            yield pd.DataFrame(rows, columns=["task_id", "lines", "redacted", "changed"])

    return first_per_id(df.select(F.col(id_col).alias("id"), F.col(text).alias("t"), "loaded_at"), "t").mapInPandas(run, "task_id string, lines int, redacted string, changed array<struct<line_no:int,line:string>>")


def put_back(text: Column, changed: Column) -> Column:
    """Redacted texts with their changed lines as they were; the round trip that shows that nothing else changed."""
    at = F.map_from_entries(changed)
    lines = F.transform(F.split(text, "\n"), lambda x, i: F.coalesce(F.element_at(at, i + 1), x))
    return F.when(F.size(changed) > 0, F.array_join(lines, "\n")).otherwise(text)
