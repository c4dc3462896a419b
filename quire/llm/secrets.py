"""Secret scans: candidates by pattern, false positives removed by a random forest.

Lines with a telling word are searched for tokens of known form and for values assigned to keys such as `password`. A
PEM private key is one finding from BEGIN to END, at the line of its BEGIN and after the other findings of that line;
without an END, it takes the header and the base64 lines that follow. The SQL cuts texts into lines and so has the header
alone, with its own score. Each candidate has FEATURES: length, character classes, transitions between classes and
between letters, dictionary coverage, and whether the path and the neighbouring words are those of examples. The
dictionary is the first WORDS whole words of a public tokenizer's vocabulary, which stands in order of frequency; its
path is a parameter. How usual a transition between letters is, is learnt from these words. A forest of TREES small trees, trained on labelled findings, votes; a
candidate with more than half of the votes is a secret. The trees are compiled to CASE expressions, so scanning runs
as DataFrame functions in one pass without a shuffle, over whole texts.

Findings to learn from are rows (value, left, right, path, label). labelled_findings() makes a default set by rules;
own reviewed findings may be given instead, up to FINDINGS rows, which bounds the fit on the driver.

Defined cases: a null or empty text has no findings; a null path is an empty path; equal findings are found as often as
they occur; a redaction replaces all occurrences of a found value in its text; ids are not read, so they may repeat or
be null, and other columns pass unchanged.
"""

from __future__ import annotations

import functools
import json
import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import table

TREES, DEPTH, FINDINGS = 15, 6, 20_000
WORDS = 1500  # of the dictionary
MASK = "[REDACTED]"

# Forms of known tokens, key words and placeholder words.
TELLING = r"(?i)akia|asia|gh[pousr]_|xox[abprs]-|[sr]k_live_|aiza|eyj|private key|passw|pwd|secret|token|api[_-]?key|access[_-]?key|auth"
FORMS = {
    "aws_key": r"A(?:KIA|SIA)[A-Z0-9]{16}",
    "github_token": r"gh[pousr]_[A-Za-z0-9]{36,}",
    "slack_token": r"xox[abprs]-[A-Za-z0-9-]{10,}",
    "stripe_key": r"[sr]k_live_[A-Za-z0-9]{16,}",
    "google_key": r"AIza[A-Za-z0-9_-]{35}",
    "jwt": r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
    "private_key": r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----",
}
KEYS = r"(?i:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|auth)"  # the end of a name of any length
VALUE = r"[A-Za-z0-9+/_=.~!@-]{8,}"
PLACEHOLDER = "example|sample|dummy|fake|placeholder|your|insert|change|xxx|todo|test|demo|redacted|foo|bar|default|none|null|true|false|undefined"

LETTERS = "abcdefghijklmnopqrstuvwxyz"


@functools.lru_cache(2)
def dictionary(path: str | None = None) -> tuple[str, ...]:
    """The first WORDS words of four letters or more of a vocabulary with word ends."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    end = model["end_of_word_suffix"]
    found = (t.removesuffix(end) for t, _ in sorted(model["vocab"].items(), key=lambda x: x[1]) if t.endswith(end))
    return tuple([w for w in found if re.fullmatch("[a-z]{4,}", w)][:WORDS])


def any_of(words) -> str:
    """A pattern that takes the longest of the words, by a tree of their letters."""
    if words == {""} or not words:
        return ""
    by: dict[str, set[str]] = {}
    for w in words:
        if w:
            by.setdefault(w[0], set()).add(w[1:])
    branches = [c + any_of(rest) for c, rest in sorted(by.items())]
    whole = branches[0] if len(branches) == 1 and "" not in words else "(?:" + "|".join(branches) + ")"
    return whole + ("?" if "" in words else "")


@functools.lru_cache(2)
def _covered(path: str | None = None) -> str:
    return any_of({*dictionary(path), *PLACEHOLDER.split("|")})


@functools.lru_cache(2)
def grades(path: str | None = None) -> str:
    """How usual each transition between letters is in the dictionary, 0 to 9, by rows of the first; row and column 0 are
    for what is no letter."""
    pairs = Counter(p for w in dictionary(path) for p in zip(w, w[1:]))
    first = Counter(w for p in pairs.elements() for w in p[:1])
    grade = lambda a, b: min(9, max(0, round(5 + 2 * math.log2((pairs[a, b] + 0.1) / (first[a] + 2.6) * 26) / 2)))
    rows = ["0" * 27] + ["0" + "".join(str(grade(a, b)) for b in LETTERS) for a in LETTERS]
    return "".join(rows)


FORM = "|".join(FORMS.values())
# Up to 24 characters before a finding are read as its context. A form begins a word; a key ends one, so the start of its name
# needs no pattern and long lines take linear time. Only blanks and values are open-ended, and nothing follows a value.
LEFT = r"([^\n]{0,24}?)"
PATTERN = LEFT + "(?:(?:^|[^A-Za-z0-9_\\n])(" + FORM + ")|(" + KEYS + r""")["']?[ \t]*(?:=>|=|:)[ \t]*["']?(""" + VALUE + "))"

# A private key over all its lines, for Spark only: to END, or, if none comes before the next BEGIN, the base64 lines that follow. The loops are possessive, so they neither recurse nor backtrack.
HEADER = FORMS["private_key"]
_GAP = r"(?:\s|\\[nr])++"
PEM = HEADER + r"(?:[^-]*+(?:-{1,4}+[^-]++)*+-----END [A-Z ]{0,20}PRIVATE KEY-----|(?:" + _GAP + r"[A-Za-z-]++: [^\n]*+)*+(?:(?:" + _GAP + r"[A-Za-z0-9+/=]{16,}+)++(?:" + _GAP + r"[A-Za-z0-9+/=]++\z)?+)?+)"

# The features in SQL;


def features(dialect: str, v: str = "value", left: str = "lft", right: str = "rgt", path: str = "path", words: str | None = None) -> dict[str, str]:
    """SQL of each feature, for `spark` or `duckdb`."""
    grade = lambda a, b: f"coalesce(try_cast(substring('{grades(words)}', cast(27 * {a} + {b} + 1 as int), 1) as int), 0)"
    spots = f"list_transform(string_split(lower({v}), ''), lambda c: instr('{LETTERS}', c))" if dialect == "duckdb" else f"transform(split(lower({v}), ''), c -> instr('{LETTERS}', c))"
    if dialect == "duckdb":
        usual = f"coalesce(list_sum(list_transform(list_zip({spots}, {spots}[2:]), lambda z: {grade('z[1]', 'z[2]')})), 0)"
    else:
        usual = f"aggregate(zip_with({spots}, slice({spots}, 2, length({v})), (a, b) -> {grade('a', 'b')}), 0, (s, x) -> s + x)"
    flag = ", 'g'" if dialect == "duckdb" else ""
    drop = lambda p, x=v, by="": f"regexp_replace({x}, '{p}', '{by}'{flag})"
    n = f"cast(length({v}) as double)"
    like = (lambda x, p: f"(case when regexp_matches({x}, '{p}') then 1.0 else 0.0 end)") if dialect == "duckdb" else (lambda x, p: f"(case when {x} rlike '{p}' then 1.0D else 0.0D end)")
    chars = f"len(list_distinct(string_split({v}, '')))" if dialect == "duckdb" else f"size(array_distinct(split({v}, '')))"
    runs = drop("[0-9]+", drop("[A-Z]+", drop("[a-z]+", v, "%"), "#"), "&")
    return {
        "size": n,
        "digits": f"(length({v}) - length({drop('[0-9]')})) / {n}",
        "capitals": f"(length({v}) - length({drop('[A-Z]')})) / {n}",
        "small": f"(length({v}) - length({drop('[a-z]')})) / {n}",
        "transitions": f"(length({runs}) - 1) / {n}",
        "variety": f"{chars} / {n}",
        "vowels": f"(length({v}) - length({drop('[aeiouAEIOU]')})) / {n}",
        "usual": f"cast({usual} as double) / {n}",
        "words": f"(length({v}) - length({drop(_covered(words), f'lower({v})')})) / {n}",
        "dots": f"(length({v}) - length({drop('[./]')})) / {n}",
        "stand_in": like(f"lower({v})", PLACEHOLDER),
        "near_example": like(f"lower(concat({left}, ' ', {right}))", "example|sample|dummy|fake|placeholder|documentation|illustration"),
        "assigned": like(left, "[=:][ \t]*[\"'']?$" if dialect == "duckdb" else "[=:][ \\t]*[\"\\']?$"),
        "example_path": like(f"lower({path})", "test|example|sample|fixture|mock|doc"),
    }


FEATURES = tuple(features("spark"))


def _numbers(rows: list[tuple], words: str | None = None) -> np.ndarray:
    """The features of findings, for training; the same rules as the SQL."""
    covered, usual = re.compile(_covered(words)), grades(words)
    near_words, path_words = "example|sample|dummy|fake|placeholder|documentation|illustration", "test|example|sample|fixture|mock|doc"

    def one(v: str, left: str, right: str, path: str) -> list[float]:
        n = len(v)
        share = lambda p, x=v: (n - len(re.sub(p, "", x))) / n
        runs = re.sub("[0-9]+", "&", re.sub("[A-Z]+", "#", re.sub("[a-z]+", "%", v)))
        near = f"{left} {right}".lower()
        spots = [LETTERS.find(c) + 1 for c in v.lower()]
        steps = sum(int(usual[27 * a + b]) for a, b in zip(spots, spots[1:]))
        found = lambda p, x: float(bool(re.search(p, x)))
        return [
            n, share("[0-9]"), share("[A-Z]"), share("[a-z]"), (len(runs) - 1) / n, len(set(v)) / n, share("[aeiouAEIOU]"), steps / n, share(covered, v.lower()),
            share("[./]"), found(PLACEHOLDER, v.lower()), found(near_words, near), found("[=:][ \t]*[\"']?$", left), found(path_words, path.lower()),
        ]

    return np.array([one(*r[:4]) for r in rows]).reshape(-1, len(FEATURES))


def labelled_findings(n: int = 3000, seed: int = 11) -> list[tuple[str, str, str, str, int]]:
    """(value, left, right, path, label): secrets drawn at random, and what resembles them."""
    r = np.random.default_rng(seed)
    pick = lambda xs: xs[int(r.integers(len(xs)))]
    draw = lambda alphabet, k: "".join(alphabet[i] for i in r.integers(len(alphabet), size=int(k)))
    up, low, dig = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
    words = dictionary()
    syllables = [a + b for a in "bcdfghlmnprstvw" for b in ("a", "e", "i", "o", "u", "an", "er", "in", "on", "ent")]
    prose = lambda: "".join(pick(syllables) for _ in range(int(r.integers(2, 6))))
    keys = ["password", "passwd", "secret", "token", "api_key", "access_key", "auth", "db_password", "SECRET"]
    b64, url = up + low + dig + "+/", up + low + dig + "-_"
    head = lambda: "-----BEGIN " + pick(["", "RSA ", "EC ", "OPENSSH ", "ENCRYPTED "]) + "PRIVATE KEY-----"
    pem = lambda h, body: h + pick(["\n", "\n", "\\n"]) + body + "\n" + h.replace("BEGIN", "END")
    lines = lambda k: "\n".join(draw(b64, 64) for _ in range(int(k))) + "\n" + draw(b64, r.integers(4, 60)) + "=="
    out = []
    for _ in range(n):
        near = " ".join(prose() for _ in range(3)) + " "
        sep = pick(["=", ": ", ' = "', "='", ":"])
        if r.random() < 0.5:
            kind = int(r.integers(11))
            size = r.integers(16, 48)
            value = [
                "AKIA" + draw(up + "234567", 16), "ghp_" + draw(up + low + dig, 36), "xoxb-" + draw(dig, 12) + "-" + draw(up + low + dig, 24),
                "sk_live_" + draw(up + low + dig, 24), "AIza" + draw(up + low + dig + "_-", 35), draw("0123456789abcdef", size),
                draw(up + low + dig + "+/", size), draw(up + low + dig, r.integers(12, 40)), draw(up + low + dig + "!@-_", r.integers(12, 24)),
                "eyJ" + draw(url, r.integers(17, 60)) + ".eyJ" + draw(url, r.integers(24, 900)) + "." + draw(url, pick([43, 86, 342, 683])), pem(head(), lines(r.integers(1, 52))) if r.random() < 0.8 else head() + "\n" + lines(r.integers(1, 52)),
            ][kind]
            left = near if (kind < 5 or kind > 8) and r.random() < 0.7 else near[-8:] + pick(keys) + sep
            out.append((value, left, " " + prose(), pick(["src/app.py", "config/prod.env", "src1", "web/main.js", "tests/test_a.py"]), 1))
        else:
            kind = int(r.integers(16))
            kind = kind - 10 if kind in (10, 11) else kind - 2 if kind > 11 else kind
            value = [
                pick(["AKIA" + draw(up + "234567", 9) + "EXAMPLE", "AKIA" + draw(up + "234567", 10) + "SAMPLE", "AKIATESTKEY" + draw(up + dig, 9), "ghp_EXAMPLE" + draw(low + dig, 29)]),
                pick(["AKIA" + pick("XA0") * 16, "ghp_" + "x" * 36, "sk_live_" + "test" * 6, "AIza" + "Sample" * 5 + "token"]), pick(["your", "my", "example", "changeme", "test"]) + pick(["-", "_", ""]) + pick(words) + pick(["", "-here", "123"]),
                prose() + prose(), pick(words) + "_" + pick(words) + pick(["", "_" + pick(words)]), pick(words) + "/" + prose() + "/" + pick(words) + ".yml",
                pick(["x", "0", "*", "a", "1"]) * int(r.integers(8, 24)), "12345678" + pick(["", "90", "9"]), pick(["os.environ", "process.env", "config.get", "self.client"]) + "." + pick(words), prose().capitalize() + pick(words),
                "eyJ" + pick("xXA0.") * int(r.integers(8, 40)) + "." + pick("xyYA0") * int(r.integers(8, 40)) + "." + pick("xzZA0") * int(r.integers(8, 43)), "eyJ" + draw(url, r.integers(10, 34)) + "." + pick(["example", "eyJexample", "payload-example", "your-payload"]) + pick(["", "-" + pick(words)]) + "." + pick(["your-signature", "example-signature", "signature-here-placeholder"]),
                head(), pem(head(), pick(["...", "[...]", "your private key here", "<insert key>", "example key", "REDACTED", pick("xX*A0") * 64, "\n".join([pick("xX*A0") * 64] * int(r.integers(2, 30))), prose() + " " + prose(), "MII" + pick("xX*A.") * int(r.integers(3, 60))])),
            ][kind]
            left = pick([near, near + "example "]) if (kind < 2 or kind > 9) and r.random() < 0.7 else near[-8:] + pick(keys) + sep
            out.append(((value + "aaaaaaaa")[:8] if len(value) < 8 else value, left, " " + prose(), pick(["src/app.py", "docs/example.md", "tests/test_b.py", "src1", "README"]), 0))
    return out


def grow(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int = DEPTH):
    """A tree: (feature, threshold, at most, above) or a vote 0 or 1, by the Gini index over random features."""
    if depth == 0 or len(y) < 8 or y.min() == y.max():
        return int(2 * y.sum() > len(y))
    best = None
    for f in sorted(rng.choice(x.shape[1], 4, replace=False)):
        values = np.unique(x[:, f])
        if len(values) < 2:
            continue
        mids = (values[1:] + values[:-1]) / 2
        for t in mids[np.unique(np.linspace(0, len(mids) - 1, 24).astype(int))]:
            left = x[:, f] <= t
            a, b = y[left], y[~left]
            gini = sum(len(s) * (1 - s.mean() ** 2 - (1 - s.mean()) ** 2) for s in (a, b) if len(s))
            if best is None or gini < best[0]:
                best = (gini, int(f), float(t), left)
    if best is None:
        return int(2 * y.sum() > len(y))
    _, f, t, left = best
    return f, t, grow(x[left], y[left], rng, depth - 1), grow(x[~left], y[~left], rng, depth - 1)


def train(findings: list[tuple], seed: int = 3) -> list:
    if len(findings) > FINDINGS:
        raise ValueError(f"at most {FINDINGS} labelled findings")
    x, y, rng = _numbers(findings), np.array([r[4] for r in findings]), np.random.default_rng(seed)
    rows = [rng.integers(len(y), size=len(y)) for _ in range(TREES)]
    return [grow(x[i], y[i], rng) for i in rows]


@functools.lru_cache(1)
def default_forest() -> tuple:
    return tuple(train(labelled_findings()))


def votes(forest, names: list[str]) -> str:
    """The forest's votes as SQL over feature columns; works in Spark and in DuckDB."""

    def case(t) -> str:
        return str(t) if isinstance(t, int) else f"case when {names[t[0]]} <= cast({t[1]!r} as double) then {case(t[2])} else {case(t[3])} end"

    return " + ".join(f"({case(t)})" for t in forest)


def _quoted(pattern: str) -> str:
    return pattern.replace("\\", "\\\\").replace("'", "\\'")


KIND = " ".join(f"when {{v}} rlike '^(?:{_quoted(p)})' then '{k}'" for k, p in FORMS.items())


def _bound(name: str, value: str, body: str) -> str:
    """`body` with `name` for the value of an expression that is evaluated once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _breaks(x: str) -> str:
    return f"cast(length({x}) - length(replace({x}, '\\n', '')) as bigint)"


def findings(text: str, path: str, forest=None) -> Column:
    """An array of (line, item, kind, value, score, secret) of a text; `text` and `path` are SQL expressions."""
    p, pem = _quoted(PATTERN), _quoted(PEM)
    place = f"coalesce(cast({path} as string), '') as path"
    # Blocks leave the text before it is cut into lines; their line breaks stay, so lines keep their numbers.
    cut_out = f"if({text} rlike '{_quoted(HEADER)}', struct(split({text}, '{pem}', -1) as around, regexp_extract_all({text}, '{pem}', 0) as blocks), struct(array({text}) as around, filter(array(''), x -> false) as blocks))"
    rest = f"array_join(transform(k.around, (x, i) -> if(i < size(k.blocks), concat(x, repeat('\\n', cast({_breaks('k.blocks[i]')} as int))), x)), '')"
    lines = f"filter(transform(split({rest}, '\\n'), (x, i) -> struct(cast(i as bigint) as line, x as row)), l -> l.row rlike '{_quoted(TELLING)}')"
    cut = f"transform(regexp_extract_all(l.row, '{p}', 0), (m, j) -> struct(l.line as line, cast(j as bigint) as item, l.row as row, regexp_extract(m, '{p}', 1) as before, regexp_extract(m, '{p}', 2) as form, regexp_extract(m, '{p}', 3) as keyed, regexp_extract(m, '{p}', 4) as given, m as m))"
    raw = f"flatten(transform({lines}, l -> {cut}))"
    value = "if(c.form <> '', c.form, c.given)"
    parts = f"transform({raw}, c -> struct(c.line, c.item, {value} as value, if(c.form <> '', 'form', 'assigned') as how, substring(c.m, 1, length(c.m) - length({value})) as lft, substring(c.row, instr(c.row, {value}) + length({value}), 16) as rgt, {place}))"
    spans = f"transform(k.blocks, (b, i) -> {_breaks('k.around[i]')} + {_breaks('b')})"
    begin = f"aggregate(slice(n, 1, i), 0L, (a, x) -> a + x) + {_breaks('k.around[i]')}"
    blocks = _bound("n", spans, f"transform(k.blocks, (b, i) -> struct({begin} as line, b as value, 'form' as how, right(substring_index(k.around[i], '\\n', -1), 25) as lft, substring(substring_index(k.around[i + 1], '\\n', 1), 1, 16) as rgt, {place}))")
    # Items of a line go on from those of its other findings.
    numbered = f"transform(q, (b, i) -> struct(b.line, cast(size(filter(f, x -> x.line = b.line)) + size(filter(slice(q, 1, i), x -> x.line = b.line)) as bigint) as item, b.value, b.how, b.lft, b.rgt, b.path))"
    both = _bound("k", cut_out, _bound("f", parts, f"if(size(k.blocks) = 0, f, concat(f, {_bound('q', blocks, numbered)}))"))
    sql = features("spark", "s.value", "s.lft", "s.rgt", "s.path")
    scored = f"transform({both}, s -> struct(s.line, s.item, s.value, s.how, {', '.join(f'{x} as {k}' for k, x in sql.items())}))"
    counted = f"transform({scored}, s -> struct(s.line, s.item, case when s.how = 'assigned' then 'assigned' {KIND.replace('{v}', 's.value')} end as kind, s.value, {votes(forest or default_forest(), [f's.{k}' for k in sql])} as n))"
    made = f"transform({counted}, s -> struct(s.line, s.item, s.kind, s.value, s.n / {TREES}D as score, 2 * s.n > {TREES} as secret))"
    return F.expr(f"if({text} rlike '{_quoted(TELLING)}', {made}, filter(array(struct(0L as line, 0L as item, '' as kind, '' as value, 0D as score, false as secret)), x -> false))")


def scan(df: DataFrame, carry: list[str], text_col: str = "text", path_col: str = "source", forest=None) -> DataFrame:
    """A row for each candidate: the columns `carry`, line_no, item, kind, value, score, is_secret."""
    found = df.select(*[F.col(f"`{c}`").alias(f"__s{i}") for i, c in enumerate(carry)], F.explode(findings(f"`{text_col}`", f"`{path_col}`", forest)).alias("__f"))
    names = {"line": "line_no", "item": "item", "kind": "kind", "value": "value", "score": "score", "secret": "is_secret"}
    return found.select(*[F.col(f"__s{i}").alias(c) for i, c in enumerate(carry)], *[F.col(f"__f.{k}").alias(v) for k, v in names.items()])


def redact(df: DataFrame, text_col: str = "text", path_col: str = "source", forest=None) -> DataFrame:
    """The rows of `df` with every secret's value masked in the text."""
    found = F.transform(F.filter(findings(f"`{text_col}`", f"`{path_col}`", forest), lambda x: x["secret"]), lambda x: F.struct((-F.length(x["value"])).alias("size"), x["value"].alias("value")))
    found = F.transform(F.array_sort(F.array_distinct(found)), lambda x: x["value"])  # the longest first, so none is cut by a part of it
    text = F.when(F.col(f"`{text_col}`").isNull(), F.col(f"`{text_col}`")).otherwise(F.aggregate(found, F.col(f"`{text_col}`"), lambda t, v: F.replace(t, v, F.lit(MASK))))
    return df.select(*[text.alias(c) if c == text_col else F.col(f"`{c}`") for c in df.columns])


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate of `documents`, scored."""
    return scan(table(spark, sf_dir, "documents"), ["doc_id"])


def scan_sql(source: str, forest=None) -> str:
    """The same as DuckDB common table expressions; the last is `found`. `source` has doc_id, text and source."""
    p, q = PATTERN.replace("'", "''"), TELLING.replace("'", "''")
    sql = features("duckdb")
    kind = " ".join(f"when regexp_matches(value, '^(?:{f})') then '{k}'" for k, f in FORMS.items())
    return f"""
s_lines AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS ln, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM {source}),
s_cut AS (SELECT doc_id, source, ln, line_no, unnest(regexp_extract_all(ln, '{p}', 0)) AS m, generate_subscripts(regexp_extract_all(ln, '{p}', 0), 1) - 1 AS item FROM s_lines WHERE regexp_matches(ln, '{q}')),
s_parts AS (SELECT doc_id, line_no, item, m, ln, coalesce(source, '') AS path, regexp_extract(m, '{p}', 2) AS form, CASE WHEN regexp_extract(m, '{p}', 2) <> '' THEN regexp_extract(m, '{p}', 2) ELSE regexp_extract(m, '{p}', 4) END AS value FROM s_cut),
s_near AS (SELECT *, substr(m, 1, length(m) - length(value)) AS lft, substr(ln, instr(ln, value) + length(value), 16) AS rgt FROM s_parts),
s_scored AS (SELECT doc_id, line_no, item, value, form, {', '.join(f'{x} AS {k}' for k, x in sql.items())} FROM s_near),
found AS (SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, CAST(item AS BIGINT) AS item, CASE WHEN form = '' THEN 'assigned' {kind} END AS kind, value, ({votes(forest or default_forest(), list(sql))}) AS n FROM s_scored)"""


def sql() -> str:
    return f"WITH {scan_sql('documents')} SELECT doc_id, line_no, item, kind, value, n / CAST({TREES} AS DOUBLE) AS score, 2 * n > {TREES} AS is_secret FROM found"
