"""Secret scans: candidates by pattern, false positives removed by a random forest.

The forest is grown on the driver from labelled findings, whose number is bounded, and becomes
one column expression: scanning, features, votes and redaction are DataFrame functions only.
Features: length, character transitions, share of digits and of different characters,
dictionary coverage, path, and the words beside the candidate.
"""

from __future__ import annotations

import functools
import random
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import fresh, let

# Words that name secrets, words that name other codes, and everyday parts of names.
SECRET_WORDS = ["password", "passwd", "pwd", "secret", "token", "apikey", "api_key", "api-key", "access_key", "auth", "credential", "private_key", "bearer"]
OTHER_WORDS = ["commit", "sha", "sha1", "sha256", "md5", "digest", "checksum", "hash", "uuid", "guid", "isbn", "etag", "revision", "rev", "version", "build", "order", "invoice", "serial", "tracking"]
DICTIONARY = [
    "access", "account", "admin", "alpha", "apple", "base", "beta", "build", "change", "channel", "client", "config", "content", "count", "create",
    "data", "date", "default", "delete", "demo", "device", "document", "dummy", "email", "error", "event", "example", "feature", "field", "file",
    "format", "from", "function", "group", "handler", "header", "hello", "here", "image", "index", "info", "input", "insert", "item", "key",
    "label", "latest", "level", "line", "list", "local", "login", "main", "manager", "message", "method", "model", "module", "name", "node",
    "number", "object", "option", "order", "output", "page", "param", "pass", "password", "path", "placeholder", "please", "port", "process",
    "production", "project", "public", "query", "read", "record", "release", "remote", "replace", "report", "request", "result", "sample", "schema",
    "secret", "section", "select", "server", "service", "session", "size", "source", "staging", "start", "state", "status", "string", "system",
    "table", "task", "test", "text", "the", "this", "time", "title", "token", "type", "update", "user", "value", "version", "view", "with", "word", "xxxx", "your",
]
#: Words that can hold a candidate: known prefixes, values after a secret's name, long codes with digits.
_KNOWN = r"(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_(?:live|test)_[A-Za-z0-9]{10,}|eyJ[A-Za-z0-9_-]{10,}(?:\.[A-Za-z0-9_-]+){1,2}|AIza[0-9A-Za-z_-]{35}"
_NAMES = "|".join(sorted(map(re.escape, SECRET_WORDS), key=len, reverse=True))
_OTHERS = "|".join(sorted(map(re.escape, OTHER_WORDS), key=len, reverse=True))
_VALUE = r"[A-Za-z0-9+/_=.~!@%^-]"
#: The password of an address, in group 1, and what stands before it.
_OF_ADDRESS, _BEFORE_ADDRESS = r"://[^/:@\s]*:([^/@\s]{4,})@", r"://[^/:@\s]*:$"
#: The secrets within a word, in group 1: after name and sign, or of a known form, or long codes; of those without a digit none.
_PATTERNS = [rf"(?i:{_NAMES})[\"']?[=:][\"']?({_VALUE}{{8,}})", rf"({_KNOWN})", r"(?<![A-Za-z0-9+/_-])([A-Za-z0-9+/_-]{16,}={0,2})", _OF_ADDRESS]
#: A secret after a name and a sign that stand apart from it, in group 1; of its word with the two words before.
_APART = rf"(?i:{_NAMES})[\"']?\x20?[=:]{{1,2}}>?\x20?[\"'`({{\[]*({_VALUE}{{8,}})[^\x20]*$"
#: The names and signs that a value of a word stands directly behind.
_BEFORE = r"((?:[A-Za-z_0-9-]+[\"']?[=:][\"']?)+)$"
FEATURES = ["length", "transitions", "digits", "different", "dictionary", "path", "named", "other", "hex", "known"]


_PATH = r"://|^[~.]{0,2}/|[A-Za-z]/[A-Za-z].*/|\.(?:js|py|css|html?|png|jpe?g|gif|svg|map|md|txt|json|java|go|rs)\b"


def features(value: str, word: str, near: str) -> list[float]:
    """The features of a finding, as _feature_columns computes them; for training and tests."""
    n = max(1, len(value))
    left = re.sub("|".join(sorted(DICTIONARY, key=len, reverse=True)), "", value.lower())
    named = bool(re.search(rf"(?i)(?<![A-Za-z])(?:{_NAMES})(?![A-Za-z])", near))
    other = bool(re.search(rf"(?i)(?<![A-Za-z])(?:{_OTHERS})(?![A-Za-z])", near))
    return [
        float(len(value)),
        (len(re.findall("[a-z]+|[A-Z]+|[0-9]+|[^a-zA-Z0-9]+", value)) - 1) / n,
        len(re.sub("[^0-9]", "", value)) / n,
        len(set(value)) / n,
        (len(value) - len(left)) / n,
        float(bool(re.search(_PATH, word))),
        float(named),
        float(other),
        float(bool(re.fullmatch("[0-9a-f]+|[0-9A-F]+", value))),
        float(bool(re.fullmatch(_KNOWN, value))),
    ]


def _feature_columns(value: Column, word: Column, near: Column) -> list[Column]:
    n = F.greatest(F.lit(1), F.length(value)).cast("double")
    flag = lambda c: c.cast("double")
    kept = lambda pattern: F.length(F.regexp_replace(value, pattern, ""))
    left = F.length(F.regexp_replace(F.lower(value), "|".join(sorted(DICTIONARY, key=len, reverse=True)), ""))
    return [
        F.length(value).cast("double"),
        (F.size(F.regexp_extract_all(value, F.lit("([a-z]+|[A-Z]+|[0-9]+|[^a-zA-Z0-9]+)"), F.lit(1))) - 1) / n,
        kept("[^0-9]") / n,
        F.size(F.array_distinct(F.regexp_extract_all(value, F.lit("(?s)(.)"), F.lit(1)))) / n,
        (F.length(value) - left) / n,
        flag(word.rlike(_PATH)),
        flag(near.rlike(rf"(?i)(?<![A-Za-z])(?:{_NAMES})(?![A-Za-z])")),
        flag(near.rlike(rf"(?i)(?<![A-Za-z])(?:{_OTHERS})(?![A-Za-z])")),
        flag(value.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")),
        flag(value.rlike(f"^(?:{_KNOWN})$")),
    ]


def labelled_findings(n: int = 2400, seed: int = 11) -> list[tuple[str, str, str, int]]:
    """(value, word, neighbouring words, 1 for a secret), made by rule; pass findings of your own to fit() instead."""
    r = random.Random(seed)
    pick = lambda alphabet, k: "".join(r.choice(alphabet) for _ in range(k))
    upper, lower, digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
    alnum, hexa = upper + lower + digits, "0123456789abcdef"
    some = lambda: " ".join(pick(lower, r.randint(2, 9)) for _ in range(2))
    camel = lambda: "".join(r.choice(DICTIONARY).capitalize() for _ in range(r.randint(2, 4)))
    apart = lambda name: r.choice((f"{some().split()[0]} {name}:", f"{name} =", f"{name} :", f'{some().split()[0]} "{name}":', f"- {name}="))
    leet = lambda: r.choice(DICTIONARY).capitalize().translate(str.maketrans("aeios", "43105")) + pick(lower, r.randint(2, 5)) + pick(digits, r.randint(1, 3)) + pick(lower, r.randint(0, 3))
    made = []
    for _ in range(n // 25):
        name = r.choice(SECRET_WORDS)
        for value, word, near, label in (
            (v := "AKIA" + pick(upper + digits, 16), v, some(), 1),
            (v := pick(hexa, r.randint(12, 64)), f"{name}={v}", f"{some()} {name}", 1),
            (v := pick(hexa, r.randint(12, 64)), f'"{v}"', f"{name} =", 1),
            (v := r.choice((pick(alnum, r.randint(4, 16)), leet())), v, "password", 1),
            (v := pick(alnum, r.randint(20, 44)), f"{name}:{v}", f"{some()} {name}", 1),
            (v := "ghp_" + pick(alnum, 36), v, some(), 1),
            (v := "sk_live_" + pick(alnum, 24), v, some(), 1),
            (v := pick(alnum + "+/", 40), v, f"{r.choice(SECRET_WORDS)} =", 1),
            (v := pick(alnum + "!@%", r.randint(10, 16)), f"{name}={v}", f"{some()} {name}", 1),
            (v := pick(lower, r.randint(4, 8)) + pick(digits, r.randint(1, 4)) + pick(lower, r.randint(3, 5)), f'"{v}"', apart(name), 1),
            (v := leet(), v, apart(name), 1),
            (v := leet() + r.choice("!@%^"), v, apart(name), 1),
            (v := pick(alnum + "!@%", r.randint(8, 20)), v, apart(name), 1),
            (v := pick(upper + lower, r.randint(12, 24)), v, apart(name), 1),
            (v := pick(hexa, r.randint(12, 64)), v, f"{r.choice(OTHER_WORDS)} {r.choice(('', ':', '='))}", 0),
            (v := pick(lower, r.randint(8, 14)) + r.choice(("", "", ".", "!")), v, apart(name), 0),
            (v := pick(upper, 1) + pick(lower, r.randint(7, 12)), v, apart(name), 0),
            (v := r.choice("-._").join(pick(lower, r.randint(3, 8)) for _ in range(r.randint(2, 3))), v, apart(name), 0),
            (v := pick(hexa, r.randint(12, 64)), f"{(o := r.choice(OTHER_WORDS))}:{v}", f"{some()} {o}", 0),
            (v := "-".join(pick(hexa, k) for k in (8, 4, 4, 4, 12)), v, some(), 0),
            (v := pick(digits, r.randint(16, 24)), v, some(), 0),
            (v := camel() + pick(digits, r.randint(1, 3)), v, some(), 0),
            (v := r.choice(("your", "example", "change", "sample", "dummy")) + "_" + r.choice(DICTIONARY) + "_" + r.choice(("here", "test", "value")), f"{name}={v}", f"{some()} {name}", 0),
            (v := "/".join((camel().lower(), camel().lower(), pick(hexa, 20))), f"https://{v}.js", some(), 0),
            (v := "_".join((r.choice(DICTIONARY), r.choice(DICTIONARY), r.choice(DICTIONARY), pick(digits, 4))), v, some(), 0),
        ):
            made.append((value, word, near, label))
    return made


def _grow(rows: list[tuple[list[float], int]], depth: int, r: random.Random):
    """A tree as nested (feature, limit, below or at it, above it); leaves are shares of secrets."""
    ones = sum(y for _, y in rows)
    if depth == 0 or ones in (0, len(rows)) or len(rows) < 8:
        return ones / len(rows)
    best = None
    for f in r.sample(range(len(FEATURES)), 4):
        values = sorted({x[f] for x, _ in rows})
        for limit in r.sample(values[:-1], min(12, len(values) - 1)):
            low = [y for x, y in rows if x[f] <= limit]
            a, b = len(low), len(rows) - len(low)
            p, q = sum(low) / a, (ones - sum(low)) / b
            impurity = a * p * (1 - p) + b * q * (1 - q)
            if best is None or impurity < best[0]:
                best = (impurity, f, limit)
    if best is None:
        return ones / len(rows)
    _, f, limit = best
    return f, limit, _grow([x for x in rows if x[0][f] <= limit], depth - 1, r), _grow([x for x in rows if x[0][f] > limit], depth - 1, r)


@functools.cache
def _default_forest() -> tuple:
    return fit(labelled_findings())


def fit(findings: list[tuple[str, str, str, int]], trees: int = 15, depth: int = 5, seed: int = 3) -> tuple:
    """A forest from labelled findings (value, word, neighbouring words, label); at least one of them."""
    r = random.Random(seed)
    rows = [(features(v, w, near), y) for v, w, near, y in findings]
    return tuple(_grow([r.choice(rows) for _ in rows], depth, r) for _ in range(trees))


def vote(forest: tuple, x: list[float]) -> float:
    def walk(node) -> float:
        while isinstance(node, tuple):
            node = node[2] if x[node[0]] <= node[1] else node[3]
        return node

    return round(sum(map(walk, forest)) / len(forest), 6)


def _vote_column(forest: tuple, x: Column) -> Column:
    def walk(node) -> Column:
        if not isinstance(node, tuple):
            return F.lit(float(node))
        f, limit, low, high = node
        return F.when(F.get(x, F.lit(f)) <= F.lit(limit), walk(low)).otherwise(walk(high))

    return F.round(functools.reduce(lambda a, b: a + b, map(walk, forest)) / len(forest), 6)


def findings(text: Column, forest: tuple) -> Column:
    """Array of (value, place, score) of every candidate in a text; place is the number of its word, from 0.

    A word has as many candidates as different values; one that lies inside another is judged too.
    """

    def of_words(w: Column) -> Column:
        def values(word: Column, beside: Column) -> Column:
            named, known, long, address = (F.regexp_extract_all(word, F.lit(p), F.lit(1)) for p in _PATTERNS)
            apart = F.when(beside.rlike("[=:]") | word.rlike("^[=:]"), F.regexp_extract_all(F.concat_ws(" ", beside, word), F.lit(_APART), F.lit(1)))
            return F.array_distinct(F.concat(named, F.coalesce(apart, F.array().cast("array<string>")), known, F.filter(long, lambda v: v.rlike("[0-9]")), address))

        def judged(word: Column, k: Column) -> Column:
            beside = F.concat_ws(" ", F.get(w, k - 2), F.get(w, k - 1))

            def judge(v: Column) -> Column:
                # A value may stand in its word several times, each behind a name of its own: the best score counts.
                parts = F.split(word, F.concat(F.lit(r"\Q"), v, F.lit(r"\E")))
                # The password of an address is no path, and the address names it.
                place = lambda p: F.when(p.rlike(_BEFORE_ADDRESS), F.struct(v.alias("word"), F.lit("password").alias("near"))).otherwise(F.struct(word.alias("word"), F.concat_ws(" ", beside, F.regexp_extract(p, _BEFORE, 1)).alias("near")))
                places = F.array_distinct(F.transform(F.slice(parts, 1, F.size(parts) - 1), place))
                score = F.array_max(F.transform(places, lambda at: let(F.array(*_feature_columns(v, at["word"], at["near"])), lambda x: _vote_column(forest, x))))
                return F.struct(v.alias("value"), k.alias("place"), score.alias("score"))

            return F.transform(values(word, beside), judge)

        sign = lambda k: F.coalesce(F.get(w, k - 1).rlike("[=:]>?[\"'`({\\[]*$"), F.lit(False))
        possible = F.transform(w, lambda word, k: F.when(word.rlike("[0-9=:]") | sign(k), judged(word, k)))
        return F.flatten(F.filter(possible, lambda c: c.isNotNull()))

    nothing = F.array().cast("array<struct<value:string,place:int,score:double>>")
    # A candidate has a digit, or stands after a name and a sign: other texts aren't split.
    return F.when(text.rlike("[0-9=:]"), let(F.split(text, r"[\x20\x09-\x0D]+"), of_words)).otherwise(nothing)


def scan(docs: DataFrame, forest: tuple | None = None, threshold: float = 0.5, mask: str = "[SECRET]", text_col: str = "text", names: tuple[str, str, str] = ("findings", "secrets", "redacted")) -> DataFrame:
    """docs with findings (value, place, score), secrets (different values scoring at least threshold) and redacted.

    redacted is the text with every occurrence of a secret replaced by mask; null texts stay null and have no findings.
    Repeated rows get equal results; an empty table gives no rows. Columns of docs that have one of the names are replaced.
    """
    listed, secrets, redacted = names
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = docs.withColumn(listed, findings(text, forest or _default_forest()))
    found = F.array_distinct(F.transform(F.filter(listed, lambda f: f["score"] >= threshold), lambda f: f["value"]))
    # Longer values first: one may lie inside another.
    order = lambda a, b: F.when(F.length(a) > F.length(b), -1).when(F.length(a) < F.length(b), 1).when(a < b, -1).when(a > b, 1).otherwise(0)
    out = out.withColumn(secrets, F.array_sort(found, order))
    masked = F.aggregate(secrets, F.col(text_col), lambda t, s: F.replace(t, s, F.lit(mask)))
    return out.withColumn(redacted, F.when(F.size(secrets) == 0, F.col(text_col)).otherwise(masked))


def redact(docs: DataFrame, forest: tuple | None = None, threshold: float = 0.5, mask: str = "[SECRET]", text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """docs with secrets masked in the text, all rows and columns kept; length_col, where there is one, follows the text."""
    names = tuple(fresh(docs, x) for x in ("findings", "secrets", "redacted"))
    _, secrets, redacted = names
    found = scan(docs, forest, threshold, mask, text_col, names).withColumn(text_col, F.col(redacted))
    if length_col in docs.columns:
        kind = docs.schema[length_col].dataType
        found = found.withColumn(length_col, F.when(F.size(secrets) > 0, F.length(text_col).cast(kind)).otherwise(F.col(length_col)))
    return found.select(*docs.columns)
