"""Credentials written into source code and configuration: where they are, and the text with them blanked.

Two things are looked for in the whole text: strings that no language would make (few characters for each subword of a
public tokenizer) and names that hold secrets. Context rules then decide on both. Beside a secret's name, in the
password's place of an address, a login or a command every value counts, however natural it is. In weaker contexts (the
key given to a cipher, the value of an Authorization header, a remark, no context but the form that a
service gives its keys) a value counts only if it is unnatural too. References, stand-ins, labels and hashes never count.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache
from heapq import merge

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanloom.plans.spread import spread

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: A value of fewer characters for each subword than this is unnatural; words and phrases have 4 and more.
UNNATURAL = 3.2
#: Strings of up to so many signs whose measure a worker keeps, the last used. Bears on speed and memory only.
KEPT_STRINGS, KEPT_SIGNS = 1 << 18, 64

# --- how a value looks -------------------------------------------------------


@lru_cache(maxsize=4)
def _encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    pattern = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    return tiktoken.Encoding("subwords", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


_SPELT = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[^\W\d_]+|\d+")


def chars_per_subword(value: str, vocabulary: str = VOCABULARY) -> float:
    """How many letters and figures a subword of the vocabulary covers on average; 0 for a value without any.

    The words of a name are read as they stand in a sentence, in lower case after a blank, so that neither the joints
    of getUserName and USER_NAME nor capitals make them look odd.
    """
    return (_kept if len(value) <= KEPT_SIGNS else _measured)(value, vocabulary)


def _measured(value: str, vocabulary: str) -> float:
    parts = _SPELT.findall(value)
    if not parts:
        return 0.0
    return sum(map(len, parts)) / len(_encoder(vocabulary).encode_ordinary(" " + " ".join(parts).lower()))


_kept = lru_cache(maxsize=KEPT_STRINGS)(_measured)


def unnatural(value: str, vocabulary: str = VOCABULARY) -> bool:
    """Fewer characters for each subword than UNNATURAL; words that are one subword each, such as short ones, are natural."""
    if chars_per_subword(value, vocabulary) >= UNNATURAL:
        return False
    words = _PATH.fullmatch(value) and re.findall(r"[^\W\d_]+", value)
    return not words or len(_encoder(vocabulary).encode_ordinary(" " + " ".join(words).lower())) > len(words)


_PATH = re.compile(r"[^\W\d_]+(?:[\-_./][^\W\d_]+)*")
_STAND_IN = re.compile(
    r"""(?ix) [*x.\-_•#?]{3,} | <[^>]*> | \[[^\]]*\] | \$\{[^:}]*\} | \$\{?\w+\}? | \$\(.*\) | \{\{.*\}\} | \#\{.*\} | %\w+% | @\w+@ | \{\w*\}
    | null | none | nil | undefined | true | false | todo | tbd | fixme | n/?a | empty | default | example | sample | dummy | placeholder
    | change[_-]?(?:me|it) | replace[_-]?\w*me\w* | (?:your|my|insert|enter|put)[_-].* | \w+_here | ENC_FROM_\w+ | (?:from_)?vault[:_./].* | redacted | masked | hidden
    | /(?:run|etc|var|opt|mnt)/.* | (?:env|vault|file|ssm|arn|kms|secret|classpath)[:/].* | .*\bvault\b.*
    | \$2[abxy]?\$\d\d\$.* | \$[156]\$.* | sha\d+[:\-].* | \{(?:ssha|sha|md5|bcrypt)\}.* | data:.*"""
)
_CJK = re.compile(r"[぀-ヿ㐀-鿿＀-￯]")


def _is_value(value: str) -> bool:
    """Not empty, no stand-in, reference, label, hash or public part."""
    return bool(value) and not re.search(r"\s", value) and not _CJK.search(value) and not _STAND_IN.fullmatch(value)


# --- names ------------------------------------------------------------------

_SECRET = {"password", "passwd", "pwd", "pass", "pw", "passphrase", "passcode", "secret", "token", "credential", "credentials", "auth", "mima", "kouling", "apikey", "passwort"}
_KEY_OF = {"api", "access", "secret", "private", "sign", "signing", "signature", "encrypt", "encryption", "crypto", "salt", "jwt", "auth", "aes", "des", "hmac", "master", "client", "service", "webhook", "account"}
_TAILS = ("password", "passwd", "pwd", "secret", "token", "passphrase", "apikey", "secretkey", "accesskey", "privatekey")
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[^\W\d_]+")


@lru_cache(maxsize=65536)
def secret_name(name: str) -> bool:
    """The last word of the name says that it holds a secret: dbPassword and jwt.secret do, passwordHint and tokenType don't."""
    words = [w.lower() for w in _PARTS.findall(name)]
    if not words:
        return False
    last = words[-1]
    if last == "key":
        return len(words) > 1 and words[-2] in _KEY_OF
    return last in _SECRET or last.endswith(_TAILS)


# --- contexts ---------------------------------------------------------------

#: Parts of the names beside which a natural value can be a credential. Only lines with one of them or with an unnatural
#: string can hold one; both are looked for in the whole text.
NAMED = (
    "pass", "pwd", "pw", "secret", "token", "key", "credential", "auth", "mima", "kouling", "://", "login", "getconnection", "mysqli",
    "aes", "jwt", "rotate", "curl", "mysql", "sudo", "bearer", "口令", "密码", "密钥", "令牌", "凭证", "凭据", "account", " / ", "账号", "帐号", "cipher", "env",
    "pdo", "pg_connect", "signin", "authenticate", "mongo", "mariadb",
)
_RUN = re.compile(r"[A-Za-z0-9+/=_\-]{12,}")
_PRIVATE = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----.*?-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----", re.S)
_LITERAL = re.compile(r"""(?<![\w\\])(?:[bBrRuUfFL@]{1,2})?(?:"((?:[^"\\]|\\.)*)"|'((?:[^'\\]|\\.)*)'|`((?:[^`\\]|\\.)*)`)""")
#: The end of a name decides, so that its last 200 characters are enough; a start at each word only keeps the search linear.
_NAME = r"(?<![\w$])[$@]?[\w$][\w$.\->\[\]]{0,200}"
_GIVEN = re.compile(rf"""({_NAME}(?:::\w{{1,200}})?)["']?\]?\s*(?:=>|:=|={{1,3}}|!={{1,2}}|:|\?=)\s*[bBrRuUfFL@]{{0,2}}$""")
_TAG = re.compile(r"""(?:name|key|id)\s*=\s*["']([^"']+)["']\s+value\s*=\s*$""", re.I)
_CALL = re.compile(r"""(?<!\w)(?:set|with|put|add|use)(\w{1,200})\(\s*[bBrRuUfFL@]{0,2}$""")
_MACRO = re.compile(r"""\bdefine\s*\(\s*["']([\w.\-]+)["']\s*,\s*$|^\s*#\s*define\s+(\w+)\s+$""")
_PUT = re.compile(r"""(?:set|put|add|append|setProperty|setHeader|header)\w{0,200}\(\s*["']([\w.\-]+)["']\s*,\s*$""", re.I)
_COMPARE = re.compile(r"""\b(?:strn?cmp|strcasecmp|equals|compare|hash_equals|compare_digest)\s*\(\s*\$?([\w.\->]+)\s*,\s*$""", re.I)
_CIPHER = re.compile(r"""\b(?:SecretKeySpec|DESKeySpec|\w{0,80}aes\w{0,80}(?:_init|\.new|_set_key)?|AES\.new|DES3?\.new|Fernet|HMAC|hmac\.new|createCipheriv|createHmac)\s*\(\s*(?:["'][\w\-]*["']\s*,\s*)?[bBrRuUfFL]{0,2}$""", re.I)
_SIGN = re.compile(r"""\bjwt\w*\.(?:sign|encode|decode|verify)\s*\([^,()]*,\s*$""", re.I)
_LOGIN = re.compile(r"""(?:\blogin|_login|Login|\.auth|authenticate|signIn)\s*\(\s*["'][^"']*["']\s*,\s*$""")
_LAST = re.compile(r"""\bgetConnection\s*\([^"']*(?:["'][^"']*["'][^"']*,)?\s*["'][^"']*["']\s*,\s*$""")
_CONNECTION = re.compile(r"""\b(?:mysqli|mysqli_connect|pg_connect|PDO)\s*\(\s*["'][^"']*["']\s*,\s*["'][^"']*["']\s*,\s*$|\bPDO\s*\([^,]*,[^,]*,\s*$""")
_DEFAULT = re.compile(r"""(?:getenv|environ\.get|env|getProperty)\s*\(\s*["']([\w.\-]+)["']\s*,\s*$|process\.env\.(\w+)\s*(?:\|\||\?\?)\s*$|(?:getenv\(["']([\w.\-]+)["']\)|\$_ENV\[["'](\w+)["']\])\s*(?:\?:|\?\?|\|\||or)\s*$""")
_CLOSED = re.compile(r"\s*\)")
_JOIN = re.compile(r"""\s*(?:[+.]\s*)?[bBrRuUfFL]{0,2}$""")
_EQUALS_AFTER = re.compile(r"""\s*\.equals(?:IgnoreCase)?\s*\(\s*([\w.]+)\s*\)|\s*[!=]={1,2}\s*\$?([\w.\->]+)""")
_SCHEME = re.compile(r"(?:Bearer|Basic|Token|Digest|ApiKey)\s+", re.I)

_URL = re.compile(r"(?<![A-Za-z0-9+.\-])[A-Za-z][A-Za-z0-9+.\-]*://[^\s:/@\"'<>?#]*:([^\s/\"'<>]+?)@(?=[A-Za-z0-9\[])")
_PAIR = re.compile(r"[?&;]\s*(?:amp;)?([\w.\-]+)=([^&;\s\"'<>]*)")
_HEADER = re.compile(r"Authorization['\"]?\s*[:=]\s*['\"]?(?:Bearer|Basic|Token|ApiKey)\s+([^\s\"'<>,;]+)|(?:X-[\w-]*(?:Key|Token|Auth)|Private-Token)\s*:\s*([^\s\"'<>,;]+)", re.I)
_PLACEHOLDER = re.compile(r"\$\{([\w.\-]+):-?([^{}]+)\}")
_OPTION = re.compile(r"(?<!\S)--?([\w\-]+)(?:=|\s+)(?:'([^']*)'|\"([^\"]*)\"|([^\s'\"=][^\s'\"]*))")
_COMMANDS = (
    re.compile(r"\b(?:mysql|mysqldump|mysqladmin|mongo|mariadb)\b[^|;\n]*?\s-p'?\"?([^\s'\"]+)"),
    re.compile(r"\bsshpass\s+-p\s*(?:'([^']*)'|\"([^\"]*)\"|(\S+))"),
    re.compile(r"\bcurl\b[^|\n]*?\s(?:-u|--user)\s*['\"]?[^\s:'\"]+:([^\s'\"]+)"),
    re.compile(r"\becho\s+(?:-n\s+)?(?:'([^']*)'|\"([^\"]*)\"|(\S+))\s*\|\s*sudo\s+-\w*S"),
)
_REMARKS = (
    re.compile(r"(?:口令|密码|密钥|令牌|凭证|凭据)\s*(?:[：:=是为]\s*)?([!-~]{4,})"),
    re.compile(r"\b(?:password|passwd|pwd|passphrase|secret|token|credential|api key|access key|pass)\s*(?:was|is|are|=|:|->)\s*([^\s\"'<>]{4,})", re.I),
    re.compile(r"\brotate\s+([^\s\"'<>]{6,})", re.I),
    re.compile(r"\blogin with \S+ and ([^\s\"'<>]{4,})", re.I),
    re.compile(r"\b(?:account|login|user)s?\s*:\s*\S+ / ([^\s\"'<>]{4,})", re.I),
    re.compile(r"(?<=\s)[\w.\-]+ / ([^\s\"'<>]{4,})(?=\s|$)"),
)
#: Forms that well-known services give their keys: fixed values.
_FORMS = re.compile(
    r"""(?<![\w\-])(?: (?:AKIA|ASIA)[0-9A-Z]{16} | gh[oprsu]_\w{20,} | github_pat_\w{20,} | glpat-[\w\-]{16,} | xox[abprs]-[\w\-]{10,} | AIza[\w\-]{35}
    | [sr]k_(?:live|test)_\w{16,} | sk-[A-Za-z0-9]{20,} | npm_\w{30,} | hf_[A-Za-z]{30,} | SG\.[\w\-]{16,}\.[\w\-]{16,} | eyJ[\w\-]{10,}\.eyJ[\w\-]{10,}\.[\w\-]+ )""",
    re.X,
)
_MARK = re.compile(r"^[\ufeff\s]*(?:#|//|/\*|\*|--|<!--|;|%)|\s(?:#|//|/\*|<!--)\s|^\s*\"\"\"")
_PLAIN = re.compile(r"^[\ufeff\s]*(?:[#;/!-]+\s*)?(?:-\s+)?(?:export\s+|set\s+|ENV\s+|ARG\s+)?([A-Za-z_][\w.\-\[\]]*)\s*[:=]\s*([^\s\"'][^\s]*)\s*(?:\s[#;].*)?$")
_ELEMENT = re.compile(r"<([\w.\-:]+)(?:\s[^<>]*)?>([^<>]*)</\1>")
_ATTRIBUTE = re.compile(r"""(?<![\w.\-:])([\w.\-:]+)\s*=\s*$""")
_CONFIGURATION = re.compile(r"(?i)(?:\.(?:properties|ya?ml|env|sh|bash|conf|cfg|ini|toml|xml|json|tf|tfvars|gradle|config|cnf|rc|pem|key|crt)(?:\.\w+)?$|^\.env|dockerfile|makefile|jenkinsfile|^[^.]*$)")


def is_configuration(filename: str | None) -> bool:
    """Whether the name marks a file of configuration or a script, where values stand without quotes."""
    return bool(filename) and bool(_CONFIGURATION.search(re.split(r"[/\\]", filename)[-1]))


def _no_word(value: str) -> bool:
    """Figures, signs or odd capitals in it show that it is neither a word nor a path, as a remark may well hold."""
    return bool(re.search(r"\d|[^\w.\-/]|[a-z][A-Z]|[A-Z]{2}[a-z]", value))


def _in_literals(block: str) -> Iterator[tuple[int, int, bool]]:
    """(start, end, sure) of the literals of lines that may be secrets by the names and calls around them.

    What stands before a literal is looked at back to the third literal before it, whatever the distance.
    """
    ends = [0, 0, 0]
    last_end, last_sure = -1, None
    at = 0
    for line in block.splitlines(keepends=True):
        for m in _LITERAL.finditer(line):
            k = m.lastindex
            if not k:
                last_sure = None
                continue
            start, end = at + m.start(k), at + m.end(k)
            value, near = m.group(k), block[ends[0] : start - 1]
            sure: bool | None = None  # None: no context at all
            if last_sure is not None and 0 <= last_end < start and _JOIN.fullmatch(block[last_end + 1 : start - 1]):
                sure = last_sure
            elif (g := _GIVEN.search(near)) and (secret_name(g[1]) or "authorization" in g[1].lower()):
                sure = True
            elif (g := _TAG.search(near)) or (g := _PUT.search(near)) or (g := _COMPARE.search(near)) or (g := _CALL.search(near)):
                sure = True if secret_name(g[1]) or "authorization" in g[1].lower() else None
            elif g := _MACRO.search(near):
                name = g[1] or g[2]
                sure = True if secret_name(name) or _PARTS.findall(name)[-1:] in (["KEY"], ["key"], ["Key"]) else None
            elif g := _DEFAULT.search(near):
                sure = True if secret_name(next(x for x in g.groups() if x)) else None
            elif _LOGIN.search(near) or _CONNECTION.search(near) or _SIGN.search(near) or (_LAST.search(near) and _CLOSED.match(block, end + 1)):
                sure = True
            elif _CIPHER.search(near):
                sure = False
            elif (g := _ATTRIBUTE.search(near)) and secret_name(g[1]):
                sure = True
            elif (g := _EQUALS_AFTER.match(line, m.end())) and secret_name(g[1] or g[2]):
                sure = True
            last_end, last_sure = end, None
            ends = [*ends[1:], end + 1]
            if sure is not None:
                if g := _SCHEME.match(value):
                    start += g.end()
                    value = value[g.end() :]
                    sure = _no_word(value)
                if _is_value(value) and "://" not in value and not value.startswith("-----"):
                    last_sure = sure
                    yield start, end, sure
        at += len(line)


def _in_line(line: str, plain: bool) -> Iterator[tuple[int, int, bool]]:
    """(start, end, sure) of what may be a secret by what stands around it on a line, literals aside."""
    for m in _FORMS.finditer(line):
        yield *m.span(), False
    for m in _URL.finditer(line):
        yield *m.span(1), True
    for m in _PAIR.finditer(line):
        if secret_name(m[1]):
            yield *m.span(2), True
    for m in _HEADER.finditer(line):
        yield *m.span(m.lastindex), m.lastindex > 1 or _no_word(m[1])
    for m in _PLACEHOLDER.finditer(line):
        if secret_name(m[1]):
            yield *m.span(2), True
    for m in _ELEMENT.finditer(line):
        if secret_name(m[1]):
            yield *m.span(2), True
    if plain:
        m = _PLAIN.match(line)
        if m and secret_name(m[1]) and m[2] not in "|>" and "://" not in m[2] and not m[2].startswith("-----"):
            yield *m.span(2), True
        for m in _OPTION.finditer(line):
            if secret_name(m[1]):
                yield *m.span(m.lastindex), True
        for pattern in _COMMANDS:
            for m in pattern.finditer(line):
                yield *m.span(m.lastindex), True
    if _MARK.search(line):
        for pattern in _REMARKS:
            for m in pattern.finditer(line):
                start, end = m.span(1)
                value = line[start:end].rstrip(".,;:)*/-><").rstrip()
                yield start, start + len(value), _no_word(value)


@lru_cache(maxsize=1)
def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for word in NAMED:
        a.add_word(word, len(word))
    a.make_automaton()
    return a


_BREAK = re.compile(r"[\r\n]")
_LINE = re.compile(r"[^\r\n]+")


def _folded(text: str) -> str:
    """The text in lower case with every character at its place."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def _continued(text: str, low: int, high: int, least: int) -> tuple[int, int]:
    """The place of the lines around the line [low, high), from `least` on, over which its statement goes on."""
    while low > least and _GOES_ON_BACK.match(text, low):
        end = low - 2 if text.startswith("\r\n", low - 2) else low - 1
        before = max(text.rfind("\n", 0, end), text.rfind("\r", 0, end)) + 1
        if not _GOES_ON.search(text, before, end):
            break
        low = before
    here, depth = low, 0
    while high < len(text):
        depth += text.count("(", here, high) - text.count(")", here, high)
        if not (_GOES_ON.search(text, here, high) or _JOINS.match(text, high) or (depth > 0 and _COMMA.search(text, here, high))):
            break
        here = high + (2 if text.startswith("\r\n", high) else 1)
        stop = _BREAK.search(text, here)
        high = stop.start() if stop else len(text)
    return low, high


#: A line that ends so goes on with the next; one that begins with a literal or a sign of joining may go on with the one before.
_GOES_ON = re.compile(r"[=+(\\.:?][ \t]*$")
_COMMA = re.compile(r",[ \t]*$")
_GOES_ON_BACK = re.compile(r"""[ \t]*(?:[bBrRuUfFL@]{0,2}["'`]|[+.])""")
_JOINS = re.compile(r"""\r?\n[ \t]*(?:[+.][ \t]*)["'`]""")


def _odd_strings(text: str, vocabulary: str) -> Iterator[int]:
    """The places of the unnatural strings of a text, rising."""
    for m in _RUN.finditer(text):
        if unnatural(m[0], vocabulary):
            yield m.start()


def credentials(text: str | None, filename: str | None = None, vocabulary: str = VOCABULARY) -> list[tuple[int, int]]:
    """(start, end) of every credential of a text in characters, rising and apart from each other."""
    if not text:
        return []
    found = {m.span() for m in _PRIVATE.finditer(text)} if "PRIVATE KEY" in text else set()
    keys = sorted(found)
    plain, done = is_configuration(filename), -1
    folded = _folded(text)
    for at in merge((k for k, _ in _automaton().iter(folded)), _odd_strings(text, vocabulary)):
        if at < done:
            continue
        low = max(text.rfind("\n", 0, at), text.rfind("\r", 0, at)) + 1
        stop = _BREAK.search(text, at)
        low, done = _continued(text, low, stop.start() if stop else len(text), max(0, done))
        block = text[low:done]
        spans = list(_in_literals(block))
        for line in _LINE.finditer(block):
            spans += ((line.start() + a, line.start() + b, sure) for a, b, sure in _in_line(line[0], plain))
        for a, b, sure in spans:
            value, span = block[a:b], (low + a, low + b)
            if _is_value(value) and (sure or unnatural(value, vocabulary)) and not any(x < span[1] and span[0] < y for x, y in keys):
                found.add(span)
    out: list[tuple[int, int]] = []
    for start, end in sorted(found, key=lambda s: (s[0], -s[1])):
        if not out or start >= out[-1][1]:
            out.append((start, end))
    return out


def blanked(text: str | None, spans: list[tuple[int, int]], mask: str = "*") -> str | None:
    """The text with every character of the spans but line ends replaced by mask; all other characters keep their places."""
    if not text or not spans:
        return text
    parts, at = [], 0
    for start, end in spans:
        parts += [text[at:start], re.sub(r"[^\r\n]", mask, text[start:end])]
        at = end
    return "".join([*parts, text[at:]])


def find_credentials(df: DataFrame, id_col: str, text_col: str, name_col: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """(id_col, start_pos, end_pos) of each credential in each text, in characters, the end exclusive.

    name_col names the file: in configuration and scripts values count without quotes too. Null, empty and blank
    texts have none; a null name counts as a program's. Texts are read whole, whatever their length, in one
    pass without a shuffle; only then the places of ids delivered twice meet. Extra columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, starts, ends = [], [], []
            for i, (text, name) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                for start, end in credentials(text, name, vocabulary):
                    rows.append(i)
                    starts.append(start)
                    ends.append(end)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], names=["id", "start_pos", "end_pos"])

    kind = df.schema[id_col].dataType.simpleString()
    texts = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{name_col}`").alias("name")).filter(F.length("text") > 0)
    return spread(texts).mapInArrow(run, f"id {kind}, start_pos int, end_pos int").dropDuplicates().withColumnRenamed("id", id_col)


def redacted(text: Column, name: Column, vocabulary: str = VOCABULARY) -> Column:
    """The text with its credentials blanked, every other character at its place; null stays null."""
    @F.pandas_udf("string")
    def run(texts: pd.Series, names: pd.Series) -> pd.Series:
        return pd.Series([blanked(t, credentials(t, n, vocabulary)) for t, n in zip(texts, names)], dtype=object)

    return run(text, name)
