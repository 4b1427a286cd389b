"""Secret scan: fixed patterns, and every other token scored by automata learned from labelled credentials."""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .automata import Automaton, learn
from .common import mapped, read_table, text_or_empty

#: Fixed patterns, in the order in which kinds are listed.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "format")
#: Candidates of the automata: whole runs of credential characters, of eight or more.
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=.-])(?:[A-Za-z0-9+/_=-]{8,}|[A-Za-z0-9]{2,5}(?=\.[A-Za-z0-9+/_=-]{16}))(?:\.[A-Za-z0-9+/_=-]{8,})*")
#: Tokens whose decision a worker remembers.
REMEMBER = 200_000
#: A candidate is a secret if its log-likelihood as a credential exceeds that as ordinary text by this much.
MARGIN = 12.0

SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
_MIXED = _LOWER + _UPPER + _DIGITS
#: Public credential formats as (prefixes, letters, lengths), a part a line where there are several.
FORMATS = {
    "aws": [(("AKIA", "ASIA", "AROA"), _UPPER + _DIGITS, (16,))],
    "github": [(("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), _MIXED, (36,))],
    "github-fine": [(("github_pat_",), _MIXED, (22,)), (("_",), _MIXED, (59,))],
    "gitlab": [(("glpat-", "glptt-", "gldt-"), _MIXED + "_-", (20,))],
    "slack": [(("xoxb-", "xoxp-", "xoxa-"), _DIGITS, (11, 12)), (("-",), _DIGITS, (11, 12)), (("-",), _MIXED, (24,))],
    "stripe": [(("sk_live_", "sk_test_", "rk_live_", "pk_live_"), _MIXED, (24, 34))],
    "google": [(("AIza",), _MIXED + "-_", (35,))],
    "google-oauth": [(("ya29.",), _MIXED + "-_", (60, 80))],
    "npm": [(("npm_",), _MIXED, (36,))],
    "pypi": [(("pypi-AgEIcHlwaS5vcmc",), _MIXED + "-_", (60, 90))],
    "model-hub": [(("hf_",), _MIXED, (34,))],
    "sendgrid": [(("SG.",), _MIXED + "-_", (22,)), ((".",), _MIXED + "-_", (43,))],
    "droplet": [(("dop_v1_",), "0123456789abcdef", (64,))],
    "shop": [(("shpat_", "shpss_"), "0123456789abcdef", (32,))],
    "sms": [(("SK", "AC"), "0123456789abcdef", (32,))],
    "mail": [(("key-",), "0123456789abcdef", (32,))],
    "square": [(("sq0atp-",), _MIXED + "-_", (22,)),],
    "jwt": [(("eyJ",), _MIXED, (17, 33)), ((".eyJ",), _MIXED, (37, 60)), ((".",), _MIXED + "-_", (43,))],
    "hex": [(("",), "0123456789abcdef", (32, 40, 64))],
    "base64": [(("",), _MIXED + "+/", (39, 43, 59)), (("=", "=="), "", (0,))],
    "plain": [(("",), _MIXED, (20, 24, 32, 40, 48))],
}
#: Common syllables of four languages and of identifiers, of which ordinary tokens are made.
SYLLABLES = (
    "the ing er tion an re on at en nd ti es or te of ed is it al ar st to nt ble ment ver con pro per com in un dis able ness ful less ly ity ous ive ize ist ship wh sh th ea ou he ha".split(),
    "sch ein ich der ung ver ent keit heit lich isch chen gen ten ber auf aus ab an be ge er en un mit nach vor ie au ei st nd ch".split(),
    "tion ment eau aux oi ou que re en le la de ai ier eur euse ique able ant ent elle ette on an un vi pa tre ch".split(),
    "cion mente ado ada ando iendo ar er ir os as es que ez osa dad ero ista ll rr ja do ga mi bo za co ie ue ra la de re".split(),
    "get set list item data base user name file path line test node type value index count map key id max min read write open close load store http www html com org net src lib bin config main module system".split(),
)


def credential(rng: random.Random, parts: list[tuple]) -> str:
    return "".join(rng.choice(prefixes) + "".join(rng.choice(letters) for _ in range(rng.choice(lengths))) for prefixes, letters, lengths in parts)


def labelled_tokens(per_kind: int = 40, seed: int = 7, without: tuple[str, ...] = ()) -> tuple[list[str], list[str]]:
    """Labelled examples made by rule: credentials of public formats (but those named in `without`) and of made-up
    prefixes, and ordinary tokens: words of four languages, identifiers, paths, numbers and dates."""
    rng = random.Random(seed)
    some = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    secrets, plain = [], []
    for _ in range(per_kind):
        secrets += [credential(rng, parts) for name, parts in FORMATS.items() if name not in without]
        for _ in range(10):
            head = some(rng.choice((_LOWER, _LOWER, _UPPER, _MIXED)), rng.randint(1, 6)) + rng.choice(("-", "_", "_", ".", "")) + rng.choice(("", "", some(_LOWER + _DIGITS, rng.randint(2, 4)) + rng.choice("-_")))
            secrets.append(head + some(rng.choice((_MIXED, _MIXED, "0123456789abcdef")), rng.choice((20, 24, 32, 36, 40))))
        for language in SYLLABLES:
            word = lambda a, b: "".join(rng.choice(language) for _ in range(rng.randint(a, b)))  # noqa: B023, E731
            made = lambda a, b: "".join(rng.choice(_LOWER) if rng.random() < 0.3 else rng.choice(language) for _ in range(rng.randint(a, b)))  # noqa: B023, E731
            for f in (str, str, str.capitalize, str.upper, str.upper):
                plain += [f(word(3, 5)), f(word(4, 9)), f(made(5, 12)), f(some(_LOWER, rng.randint(1, 3)) + word(3, 8))]
            plain += [
                word(1, 2) + "".join(word(1, 2).capitalize() for _ in range(rng.randint(1, 4))),
                "".join(word(1, 2).capitalize() for _ in range(rng.randint(2, 4))),
                "_".join(word(1, 3) for _ in range(rng.randint(2, 5))),
                "_".join(word(1, 2) for _ in range(rng.randint(2, 4))).upper(),
                "-".join(word(1, 3) for _ in range(rng.randint(2, 6))),
                rng.choice(("", "/")) + "/".join(word(1, 3) for _ in range(rng.randint(2, 6))),
                "/" + "/".join(word(1, 2) for _ in range(3)) + "/" + some(_DIGITS, 3),
                word(2, 4) + some(_DIGITS, rng.randint(1, 4)) + rng.choice(("", word(1, 3))),
            ]
        uuid = "-".join(some("0123456789abcdef", n) for n in (8, 4, 4, 4, 12))
        plain += [
            some(_DIGITS, rng.randint(8, 20)), some(_DIGITS, 4) + "-" + some(_DIGITS, 2) + "-" + some(_DIGITS, 2), "20" + some(_DIGITS, 2) + "-0" + some("123456789", 1) + "-" + some("12", 2) + "T" + some("01", 2),
            "-".join(some(_DIGITS, 4) for _ in range(4)), "-".join(some(_DIGITS, 3) for _ in range(2)) + some(_DIGITS, 4), "+" + some(_DIGITS, 11), uuid,
            rng.choice("-=_+/") * rng.randint(8, 60), some(_DIGITS, 2) + "/" + some(_DIGITS, 2) + "/" + some(_DIGITS, 4), "v" + some(_DIGITS, 1) + "-" + some(_DIGITS, 2) + "-" + some(_DIGITS, 3),
        ]
    return secrets, plain


class Judge:
    """Scores tokens by the credential automaton against the one of ordinary tokens; remembers its decisions."""

    def __init__(self, secret: Automaton, plain: Automaton, margin: float = MARGIN):
        self.secret, self.plain, self.margin, self.known = secret, plain, margin, {}

    def score(self, token: str) -> float:
        """Log-likelihood ratio of the token: as a credential against as an ordinary token."""
        return self.secret.log_likelihood(token) - self.plain.log_likelihood(token)

    def __call__(self, token: str) -> bool:
        found = self.known.get(token)
        if found is None:
            if len(self.known) >= REMEMBER:
                self.known.clear()
            found = self.score(token) > self.margin
            if len(token) <= 64:
                self.known[token] = found
        return found


@cache
def models() -> tuple[Automaton, Automaton]:
    """The credential automaton and the one of ordinary tokens, learned once in the driver from a fixed seed."""
    secrets, plain = labelled_tokens()
    return learn(secrets), learn(plain)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The spans of the fixed patterns, by kind."""
    out = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    return out


def find_spans(text: str, judge: Judge | None = None) -> list[tuple[str, int, int]]:
    """All spans of a text by start, then kind. A candidate that a base span overlaps is not reported again."""
    judge = judge or Judge(*models())
    out = base_spans(text)
    taken = sorted((s, e) for _, s, e in out)
    at = 0
    for m in CANDIDATE.finditer(text):
        s, e = m.span()
        while at < len(taken) and taken[at][1] <= s:
            at += 1
        if at < len(taken) and taken[at][0] < e:
            continue
        if judge(m[0]):
            out.append(("format", s, e))
    out.sort(key=lambda x: (x[1], KINDS.index(x[0]), x[2]))
    return out


def scan_secrets(df: DataFrame, text: str = "text", out: str = "spans", margin: float = MARGIN) -> DataFrame:
    """Adds `out`, the array of spans (kind, start, end; code points, end exclusive), to every row of `df`.

    Null text counts as empty: no spans. Repeated rows get equal spans; an empty table gives an empty table. Other
    columns pass through; one named like `out`, in any case, is replaced. Rows are handled one by one: no shuffle, no
    row limit."""
    df = df.drop(out)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    automata = models()

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(*automata, margin)
        for b in it:
            found = [[{"kind": k, "start": s, "end": e} for k, s, e in find_spans(t or "", judge)] for t in b.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, kind)], [*b.schema.names, out])

    return mapped(df, batches, T.StructType([*df.schema.fields, T.StructField(out, SPANS)]))


def redact_secrets(df: DataFrame, text: str = "text", mask: str = "[SECRET]", margin: float = MARGIN) -> DataFrame:
    """`df` with every span in `text` replaced by `mask` (overlapping spans by one). Null stays null; a text without
    spans is left as it is. Columns keep their names, order and types; repeated rows are changed alike, and an empty
    table stays empty."""
    automata = models()

    def clean(t: str | None, judge: Judge) -> str | None:
        if t is None or not (spans := find_spans(t, judge)):
            return t
        parts, at = [], 0
        for _, s, e in spans:
            if s >= at:
                parts += [t[at:s], mask]
            at = max(at, e)
        return "".join(parts) + t[at:]

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(*automata, margin)
        for b in it:
            i = b.schema.get_field_index(text)
            columns = list(b.columns)
            columns[i] = pa.array([clean(t, judge) for t in b.column(i).to_pylist()], b.schema.field(i).type)
            yield pa.RecordBatch.from_arrays(columns, schema=b.schema)

    return mapped(df, batches, df.schema)


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's spans: counts of the base kinds, their digest, and all spans as text."""
    docs = read_table(spark, sf_dir, "documents")
    found = scan_secrets(docs.select("doc_id", text_or_empty(docs).alias("text"))).drop("text")
    tell = lambda a: F.concat_ws(",", F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))
    many = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long")
    base = F.filter("spans", lambda x: x["kind"] != "format")
    return found.select("doc_id", many("assign").alias("n_assign"), many("access").alias("n_access"), many("hex").alias("n_hex"), F.sha2(tell(base), 256).alias("base_sha256"), tell(F.col("spans")).alias("spans"))


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document stays, its secrets masked; n_chars follows the text."""
    return redact_secrets(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


QUERIES = {"op2_secrets": op2_secrets}
ORACLES: dict[str, str] = {}
