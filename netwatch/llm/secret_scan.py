"""Secret scan: fixed patterns, and a randomness test battery for what no pattern names (DataFrame functions only).

Patterns find assignments, access keys and hex strings. Beyond them every run of 20 or more token characters is
tested. Its encoding is inferred (decimal, hex, base 32, base 62 or base 64), its characters become numbers of that
alphabet, and three tests ask whether they look drawn at random: chi-squared uniformity over the alphabet, the runs
test about the middle of the alphabet, and the lag-1 serial correlation. The three deviates are combined into one
score; random strings score low. They look at the eighth, the
half and the quarter of the alphabet that a letter lies in.

Whether a low score means anything depends on length and encoding, since short stretches of words, and most runs of digits, can look
random. So scores are compared with those of ordinary text of the same length band in the same alphabet: the characters of
every text that belong to an alphabet are cut end to end into stretches, whose lengths go round the bands from one that the
text's hash picks. That gives each candidate a p-value, and the Benjamini-Hochberg rule sets one score cutoff for each band and
encoding that keeps the expected share of false findings below ``rate``. All texts count for this, equal stretches and equal
tokens once; the counts are a histogram of fixed size.

Positions are code points, ends exclusive. Findings of the battery that overlap a pattern's finding are left out.
Defined results: a null text is empty; an empty corpus, or one without running text of an encoding, gives no battery findings there. Rows
without an id and repeated rows each have their result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from netwatch.llm.common import let, running_totals

ASSIGN = (r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "random")
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"

#: Length bands of the battery: lower ends.
BANDS = (20, 24, 28, 32, 40, 56, 80)
_STEP, _TOP = 0.25, 400
_UPPER, _LOWER, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"

_SPAN = "array<struct<start:bigint,kind:int,end:bigint>>"


def _no_spans() -> Column:
    return F.array().cast(_SPAN)


def _spans(text: Column, pattern: str, kind: int, passes) -> Column:
    """Spans of the pattern's leftmost non-overlapping matches that pass. The pieces between matches give positions."""
    def place(found: Column) -> Column:
        gaps, hits = found["gaps"], found["hits"]
        steps = F.transform(hits, lambda h, i: F.get(gaps, i) + F.length(h))

        def span(starts: Column) -> Column:
            return F.transform(hits, lambda h, i: F.struct(
                (F.get(starts, i) + F.get(gaps, i)).cast("bigint").alias("start"), F.lit(kind).alias("kind"),
                (F.get(starts, i) + F.get(gaps, i) + F.length(h)).cast("bigint").alias("end")))
        return let(running_totals(steps), lambda starts: F.filter(span(starts), lambda s, i: passes(found, i)))

    found = F.struct(
        F.transform(F.split(text, pattern, -1), F.length).alias("gaps"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"),
        *([F.regexp_extract_all(text, F.lit(pattern), F.lit(2)).alias("values")] if pattern == ASSIGN else []))
    return F.when(text.rlike(pattern if pattern != HEX else "[0-9a-f]{24}"), let(found, place)).otherwise(_no_spans())


def base_spans(text: Column) -> Column:
    """All pattern findings, sorted by start and kind."""
    return F.sort_array(F.concat(
        _spans(text, ASSIGN, 0, lambda f, i: F.length(F.get(f["values"], i)) >= 6),
        _spans(text, ACCESS, 1, lambda f, i: F.length(F.get(f["hits"], i)) >= 20),
        _spans(text, HEX, 2, lambda f, i: F.length(F.get(f["hits"], i)) >= 24)))


#: Encodings of the battery, each with its characters in their order of value.
ENCODINGS = ("decimal", "hex", "base32", "base62", "base64")
_ALPHABETS = (_DIGITS, _DIGITS + "abcdef", _UPPER + "234567", _UPPER + _LOWER + _DIGITS, _UPPER + _LOWER + _DIGITS + "+/")
_SIZES = tuple(len(x) for x in _ALPHABETS)
#: The eighth of its alphabet that each value lies in, and the share of values in each eighth; base 64 has base 62's eighths. The 20 letters
#: of a short token would leave less than one to a letter, too few for chi-squared.
_CELLS = tuple("".join(str(min(8 * v // n, 7)) for v in range(len(x))) for x, n in zip(_ALPHABETS, (*_SIZES[:-1], _SIZES[-2])))
_SHARES = tuple(tuple(cells.count(str(i)) / len(cells) for i in range(8)) for cells in _CELLS)
#: Letters that are worked on at once: the octal digits of a long, the last of which the next ones begin with.
_STEP_OF, _DIGIT = 20, int("1" * 21, 8)


def _encoding(token: Column) -> Column:
    """The inferred encoding's number."""
    return (F.when(token.rlike("^[0-9]+=*$"), 0).when(token.rlike("^(?:[0-9a-f]+|[0-9A-F]+)=*$"), 1)
            .when(token.rlike("^[A-Z2-7]+=*$"), 2).when(token.rlike("^[A-Za-z0-9]+=*$"), 3).otherwise(4))


def _sums(core: Column, encoding: Column) -> Column:
    """What the three tests need of a token: its letters become octal digits (the eighth of the alphabet), 21 digits a long, and
    counts of letters and of steps between neighbours become counts of bits."""
    def at_once(cells: Column) -> Column:
        n = F.length(cells)
        parts = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / _STEP_OF).cast("int")), lambda j: let(
            F.substr(cells, j * _STEP_OF + 1, F.lit(_STEP_OF + 1)), lambda part: F.struct(
                F.conv(part, 8, 10).cast("bigint").alias("x"), F.length(part).alias("m"))))
        return F.struct(n.cast("double").alias("n"), F.transform(parts, bits).alias("parts"),
                        F.substr(cells, F.lit(1), F.lit(1)).alias("first"), F.substr(cells, n, F.lit(1)).alias("last"))

    def bits(part: Column) -> Column:
        plane = lambda i: F.shiftright(part["x"], i).bitwiseAND(F.lit(_DIGIT))
        # The 21st letter belongs to the next part; pairs are told by their second letter.
        own = F.when(part["m"] > _STEP_OF, F.lit(_DIGIT - 1)).otherwise(F.lit(_DIGIT))
        pairs = F.call_function("shiftleft", F.lit(1).cast("bigint"), 3 * (part["m"] - 1)) - 1
        return F.struct(*[plane(i).alias(name) for i, name in ((2, "h"), (1, "m"), (0, "l"))], own.alias("own"), pairs.alias("pairs"))

    def count(a: Column, p: Column) -> Column:
        ones = lambda *planes: F.bit_count(reduce(Column.bitwiseAND, planes)).cast("double")
        h, m, low, own, before = p["h"], p["m"], p["l"], p["own"], lambda x: F.shiftright(x, 3)
        return F.struct(*[(a[name] + value).alias(name) for name, value in (
            ("h", ones(h, own)), ("m", ones(m, own)), ("l", ones(low, own)), ("hm", ones(h, m, own)), ("hl", ones(h, low, own)),
            ("ml", ones(m, low, own)), ("hml", ones(h, m, low, own)), ("turns", ones(h.bitwiseXOR(before(h)), p["pairs"])),
            ("products", 4 * ones(h, before(h)) + 2 * ones(h, before(m)) + 2 * ones(m, before(h)) + ones(m, before(m))))])

    zero = F.struct(*[F.lit(0.0).alias(n) for n in ("h", "m", "l", "hm", "hl", "ml", "hml", "turns", "products")])
    cells = F.when(encoding == 0, F.translate(core, _ALPHABETS[0], _CELLS[0]))
    for e in range(1, len(ENCODINGS)):
        cells = cells.when(encoding == e, F.translate(core, _ALPHABETS[e], _CELLS[e]))
    return let(let(cells, at_once), lambda k: F.struct(
        k["n"].alias("n"), F.aggregate(k["parts"], zero, count).alias("of"),
        *[F.floor(k[x].try_cast("int") / 2).cast("double").alias(x) for x in ("first", "last")]))


def _score(sums: Column, encoding: Column) -> Column:
    """The combined score: the sum of the squared deviates of the three tests. Chi-squared uniformity of the letters over the eighths
    of the alphabet counts only above its expectation; runs are about the middle of the alphabet, and the serial correlation is that of
    the quarters of the alphabet that letters lie in."""
    def cells(s: Column) -> Column:
        h, m, low, hm, hl, ml, hml = (s["of"][x] for x in ("h", "m", "l", "hm", "hl", "ml", "hml"))
        return F.array(s["n"] - h - m - low + hm + hl + ml - hml, low - hl - ml + hml, m - hm - ml + hml, ml - hml,
                       h - hm - hl + hml, hl - hml, hm - hml, hml)

    def deviates(s: Column) -> Column:
        n, above, of = s["n"], s["of"]["h"], s["of"]
        freedom = 7
        expected = F.get(F.array(*[F.array(*[F.lit(1 / x) for x in shares]) for shares in _SHARES]), encoding)
        squares = F.aggregate(F.zip_with(cells(s), expected, lambda c, e: c * c * e), F.lit(0.0), lambda a, x: a + x)
        chi = (F.cbrt((squares / n - n) / freedom) - (1 - 2 / (9 * freedom))) / (2 / (9 * freedom)) ** 0.5
        return F.struct(
            F.greatest(chi, F.lit(0.0)).alias("chi"), n.alias("n"), (1 + of["turns"]).alias("runs"), s["first"].alias("first"),
            s["last"].alias("last"), (2 * above * (n - above) / n + 1).alias("mean"), of["products"].alias("products"),
            ((2 * of["h"] + of["m"]) / n).alias("centre"), (4 * of["h"] + of["m"] + 4 * of["hm"]).alias("square"))

    def combine(d: Column) -> Column:
        spread = (d["mean"] - 1) * (d["mean"] - 2) / (d["n"] - 1)
        by_runs = F.when(spread > 0, F.pow(d["runs"] - d["mean"], F.lit(2.0)) / spread).otherwise(100.0)
        variance = d["square"] - d["n"] * d["centre"] * d["centre"]
        lagged = d["products"] - d["centre"] * ((d["n"] + 1) * d["centre"] - d["first"] - d["last"])
        serial = F.when(variance > 1e-6, F.pow(lagged / variance + 1 / d["n"], F.lit(2.0)) * d["n"]).otherwise(100.0)
        return d["chi"] * d["chi"] + by_runs + serial
    return let(let(sums, deviates), combine)


def _battery(token: Column, encoding: Column) -> Column:
    """The score of a token in its encoding; tokens of two characters or fewer have the highest."""
    core = F.regexp_replace(token, "=+$", "")
    plain = F.when(encoding == 1, F.lower(core)).otherwise(F.translate(core, "-_", "+/"))
    return F.when(F.length(core) > 2, _score(_sums(plain, encoding), encoding)).otherwise(F.lit(float(_TOP)))


def _cut_up(letters: Column) -> Column:
    """Consecutive stretches of the bands' lengths, null in place of those that the end cuts."""
    rounds = []
    for first in range(len(BANDS)):
        lengths = BANDS[first:] + BANDS[:first]
        rounds.append(F.array(*[F.struct(F.lit(sum(lengths[:i]) + 1).alias("start"), F.lit(n).alias("n"))
                                for i, n in enumerate(lengths)]))

    def cut(known: Column) -> Column:
        return F.flatten(F.transform(known["pieces"], lambda piece: F.transform(known["round"], lambda r: F.when(
            F.length(piece) >= r["start"] + r["n"] - 1, F.substr(piece, r["start"], r["n"])))))
    return let(letters, lambda known: let(F.struct(
        F.regexp_extract_all(known, F.lit(f".{{1,{sum(BANDS)}}}"), F.lit(0)).alias("pieces"),
        F.get(F.array(*rounds), F.pmod(F.xxhash64(known), F.lit(len(BANDS))).cast("int")).alias("round")), cut))


#: What each encoding's ordinary stretches leave out of a text's Latin letters and digits. Base 64 shares base 62's.
_OTHERS = ("[^0-9]+", "[^0-9a-f]+", "[^A-Z2-7]+", None)
_MARKS = "".join(chr(c) for c in [9, 10, 13, *range(32, 127)] if not chr(c).isalnum())


def _stretches(text: Column) -> Column:
    """(token, encoding) of a text's ordinary stretches: its characters of each alphabet, end to end."""
    def of(plain: Column, others: str | None, encoding: int) -> Column:
        return F.transform(_cut_up(F.regexp_replace(plain, others, "") if others else plain), lambda t: F.struct(
            t.alias("token"), F.lit(encoding).alias("encoding")))
    # Most of what goes are the marks of ASCII, which need no pattern.
    plain = F.regexp_replace(F.translate(text, _MARKS, ""), "[^A-Za-z0-9]+", "")
    return let(plain, lambda p: F.concat(*[of(p, others, e) for e, others in enumerate(_OTHERS)]))


def _is_candidate(token: Column) -> Column:
    """Digits with letters, or capitals inside: what encodings of random bytes have, and words haven't."""
    return ((token.rlike("[0-9]") & token.rlike("[A-Za-z]")) | (token.rlike("[a-z]") & token.rlike(".[A-Z]")) |
            token.rlike("^[0-9]+$"))


def _band(length: Column) -> Column:
    return sum((length >= b).cast("int") for b in BANDS[1:])


def _bucket(score: Column) -> Column:
    return F.least(F.floor(score / _STEP), F.lit(_TOP)).cast("int")


def calibrate(docs: DataFrame, text: str = "text", rate: float = 0.05) -> DataFrame:
    """(band, encoding, cutoff): score buckets up to the cutoff are findings of that length band and encoding. At most one row for
    each of both."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    tokens = F.transform(F.filter(F.regexp_extract_all(body, F.lit(TOKEN), F.lit(0)), _is_candidate),
                         lambda t: F.struct(t.alias("token"), _encoding(t).alias("encoding"), F.lit(False).alias("plain")))
    plain = F.transform(_stretches(body), lambda t: F.struct(t["token"].alias("token"), t["encoding"].alias("encoding"),
                                                             F.lit(True).alias("plain")))
    found = (docs.select(F.explode(F.concat(tokens, plain)).alias("x")).where(F.col("x.token").isNotNull())
             .select("x.*", _band(F.length("x.token")).alias("band")))
    base62, base64 = ENCODINGS.index("base62"), ENCODINGS.index("base64")
    # Ordinary base 62 stretches stand for base 64 as well: the same sums, judged by its shares.
    core = F.regexp_replace("token", "=+$", "")
    spelt = F.when(F.col("encoding") == 1, F.lower(core)).otherwise(F.translate(core, "-_", "+/"))
    scores = let(_sums(spelt, F.col("encoding")), lambda s: F.array(
        F.struct(F.col("encoding").alias("encoding"), _bucket(_score(s, F.col("encoding"))).alias("bucket")),
        F.when(F.col("plain") & (F.col("encoding") == base62), F.struct(
            F.lit(base64).alias("encoding"), _bucket(_score(s, F.lit(base64))).alias("bucket")))))
    top = F.array(F.struct(F.col("encoding").alias("encoding"), F.lit(_TOP).alias("bucket")))
    scored = (found.select("plain", F.xxhash64("token").alias("hash"), "band", F.explode(
                  F.when(F.length(core) > 2, scores).otherwise(top)).alias("s"))
              .where(F.col("s").isNotNull()).select("plain", "hash", "band", "s.encoding", "s.bucket")
              .distinct())  # copies of a text, a passage or a token are no further evidence
    counted = scored.groupBy("band", "encoding", "bucket").agg(
        F.sum(F.when(F.col("plain"), 1).otherwise(0)).alias("plain"),
        F.sum(F.when(F.col("plain"), 0).otherwise(1)).alias("candidates"))
    whole = Window.partitionBy("band", "encoding")
    along = whole.orderBy("bucket")
    ranked = counted.select(
        "band", "encoding", "bucket", F.sum("plain").over(along).alias("nulls"), F.sum("plain").over(whole).alias("all_nulls"),
        F.sum("candidates").over(along).alias("found"), F.sum("candidates").over(whole).alias("tested"))
    # p-value (nulls + 1) / (all_nulls + 1) against rate * found / tested, without divisions.
    passes = (F.col("nulls") + 1) * F.col("tested") <= rate * F.col("found") * (F.col("all_nulls") + 1)
    return (ranked.where(passes & (F.col("all_nulls") > 0) & (F.col("found") > 0))
            .groupBy("band", "encoding").agg(F.max("bucket").alias("cutoff")))


def random_spans(text: Column, cutoffs: dict[tuple[int, int], int]) -> Column:
    """Spans of the tokens that the battery finds random under the cutoffs ((band, encoding) -> score bucket)."""
    if not cutoffs:
        return _no_spans()
    table = F.array(*[F.lit(cutoffs.get((b, e), -1)) for b in range(len(BANDS)) for e in range(len(ENCODINGS))])

    def passes(found: Column, i: Column) -> Column:
        return let(F.get(found["hits"], i), lambda token: let(_encoding(token), lambda e: _is_candidate(token) & (
            _bucket(_battery(token, e)) <= F.get(table, _band(F.length(token)) * len(ENCODINGS) + e))))
    return _spans(text, TOKEN, 3, passes)


def find_secrets(docs: DataFrame, text: str = "text", rate: float = 0.05) -> DataFrame:
    """All columns as struct ``doc``, the text, base spans and all spans (start, kind number, end)."""
    # At most one row for each band and encoding.
    cutoffs = {(r["band"], r["encoding"]): r["cutoff"] for r in calibrate(docs, text, rate).collect()}
    body = docs.select(F.struct("*").alias("doc"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))
    found = body.select("doc", "_text", base_spans(F.col("_text")).alias("base"),
                        random_spans(F.col("_text"), cutoffs).alias("random"))
    apart = F.filter("random", lambda r: ~F.exists("base", lambda b: (b["start"] < r["end"]) & (r["start"] < b["end"])))
    return found.select("doc", "_text", "base", F.sort_array(F.concat("base", apart)).alias("spans"))


def span_list(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random."""
    found = find_secrets(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))
    count = lambda spans, kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")
    return found.select(
        "doc.doc_id", *[count("base", i).alias(f"n_{KINDS[i]}") for i in range(3)],
        F.sha2(span_list(F.col("base")), 256).alias("base_sha256"), span_list(F.col("spans")).alias("spans"),
        count("spans", 3).alias("n_random"))


_PAGE = 1000


def _cut(pages: Column, start: Column, end: Column) -> Column:
    """Code points start to end of a text that is given in pages; only the pages at the ends are searched."""
    first, last = F.floor(start / _PAGE).cast("int"), F.floor(end / _PAGE).cast("int")
    head = F.coalesce(F.get(pages, first), F.lit(""))
    begin = (start % _PAGE + 1).cast("int")
    return F.when(first == last, F.substr(head, begin, (end - start).cast("int"))).otherwise(F.concat(
        F.substr(head, begin, F.lit(_PAGE)), F.array_join(F.slice(pages, first + 2, F.greatest(last - first - 1, F.lit(0))), ""),
        F.coalesce(F.substr(F.get(pages, last), F.lit(1), (end % _PAGE).cast("int")), F.lit(""))))


def redact(text: Column, spans: Column) -> Column:
    """The text with each finding, or union of overlapping findings, replaced by ``[SECRET]``."""
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<a:bigint,b:bigint>>").alias("keep"))
    gaps = F.aggregate(spans, start, lambda acc, s: F.struct(
        F.greatest(acc["at"], s["end"]).alias("at"),
        F.when(s["start"] >= acc["at"], F.concat(acc["keep"], F.array(F.struct(
            acc["at"].alias("a"), s["start"].alias("b"))))).otherwise(acc["keep"]).alias("keep")))

    def build(known: Column) -> Column:
        pages, cuts = known["pages"], known["cuts"]
        kept = F.transform(cuts["keep"], lambda g: _cut(pages, g["a"], g["b"]))
        return F.concat(F.array_join(kept, "[SECRET]"), F.lit("[SECRET]"), _cut(pages, cuts["at"], known["size"]))

    known = F.struct(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_PAGE}}}"), F.lit(0)).alias("pages"), gaps.alias("cuts"),
                     F.length(text).cast("bigint").alias("size"))
    return F.when(F.size(spans) > 0, let(known, build)).otherwise(text)


def redact_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents with their secrets redacted in ``text``; all other columns as they are, null texts stay null."""
    found = find_secrets(docs, text)
    clean = F.when(F.col(f"doc.{text}").isNotNull(), redact(F.col("_text"), F.col("spans")))
    return found.select(*[clean.alias(c) if c == text else F.col(f"doc.`{c}`") for c in docs.columns])
