"""Secret scans, in DataFrame operations alone.

Base patterns find assigned secrets, access keys and long hexadecimal runs. Beyond them, every
run of 20 or more characters of the encodings' alphabets, less what base spans cover of it, is
put to a battery of randomness tests over the encoding inferred from its characters (decimal and
hexadecimal digits, base 32, letters and digits, base 64): chi-squared uniformity over the
alphabet, runs above and below the alphabet's middle, and correlation of neighbours. The least of
the three p-values, times three, is the run's.

Runs whose p-value the Benjamini-Hochberg step rejects, within their encoding and length over the
whole corpus, are structured text, and a run must carry at least LEAST_BITS bits if random. Each
other run is kept if the false share among its like (encoding, length, and p-value no smaller) is
estimated within FALSE_SHARE at its p-value or a smaller one:

* Of runs with digits and letters, the false ones are put at the larger of two estimates: the
  structured runs times the share of plain words (letters or digits alone) of like length that
  pass, beyond the keys to be expected among them, neighbouring lengths pooled while plain words
  are few; and the runs as far below the
  rejection bound as these are above it, for structured text thins out towards large p-values.
* A run without digits is a key only by chance: as many are expected as the kept runs with digits
  imply by their alphabet and length, and what is found beyond these is false. Digits alone are
  a number and stay out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.base import materialise

#: The base patterns, by kind in their order; fixed values. Hexadecimal runs and access keys are
#: written with their least lengths, which finds the same spans: a shorter match of theirs ends
#: where its run of characters ends, so it hides no other.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
LEAST_ASSIGNED = 6

CANDIDATE = r"[A-Za-z0-9+/_-]{20,}"
KINDS = ("assign", "access", "hex", "random")
LEAST_BITS = 80
FALSE_SHARE = 0.1
REJECT_AT = 0.05
#: Plain words that a length's share is taken from at least, where the corpus has them.
LEAST_PLAIN = 30
_SHORTEST = 20
_BINS = 64

_DIGITS = "0123456789"
_LOWER = "abcdefghijklmnopqrstuvwxyz"
#: Alphabets of the encodings, smallest first.
ALPHABETS = (
    ("dec", _DIGITS),
    ("hex", _DIGITS + "abcdef"),
    ("HEX", _DIGITS + "ABCDEF"),
    ("b32", _LOWER.upper() + "234567"),
    ("b36", _DIGITS + _LOWER),
    ("B36", _DIGITS + _LOWER.upper()),
    ("b62", _DIGITS + _LOWER.upper() + _LOWER),
    ("b64", _LOWER.upper() + _LOWER + _DIGITS + "+/"),
    ("url", _LOWER.upper() + _LOWER + _DIGITS + "-_"),
)


#: Numbers that a running sum goes over at once; see running().
_STEP = 128
_SPAN = "array<struct<start:int,kind:int,end:int>>"


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _sums(numbers: Column) -> Column:
    """0 and the sums of the first one, two, ... numbers; for short arrays, since each sum copies those before it."""
    return F.aggregate(numbers, F.array(F.lit(0).cast("long")), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))


def running(numbers: Column) -> Column:
    """The running sums of an array of longs, in steps of _STEP numbers and then over the steps, so long arrays cost little more a number than short ones."""
    based = lambda sums, bases: F.flatten(F.transform(sums, lambda s, i: F.transform(F.slice(s, F.lit(2), F.lit(_STEP)), lambda x: x + F.get(bases, i))))
    whole = lambda sums: _let(_sums(F.transform(sums, lambda s: F.element_at(s, -1))), lambda bases: based(sums, bases))
    parts = lambda v: F.transform(F.sequence(F.lit(1), F.greatest(F.size(v), F.lit(1)), F.lit(_STEP)), lambda a: _sums(F.slice(v, a, F.lit(_STEP))))
    return _let(numbers, lambda v: _let(parts(v), whole))


def spans(text: Column, pattern: str, kind: int, least: int = 0, group: int = 0) -> Column:
    """Leftmost non-overlapping matches as structs (start, kind, end, found), in code points; least is of the group's length.

    The pieces between the matches and the matches alternate, so a match ends where the running
    sum of both lengths is.
    """
    empty = F.array().cast("array<struct<start:int,kind:int,end:int,found:string>>")
    long = lambda m: F.char_length(F.regexp_extract(m, pattern, group)) >= least if group else F.char_length(m) >= least

    def placed(matches: Column) -> Column:
        sizes = F.zip_with(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(matches)), matches, lambda p, m: (F.char_length(p) + F.char_length(m)).cast("long"))
        made = F.zip_with(matches, running(sizes), lambda m, e: F.struct((e - F.char_length(m)).cast("int").alias("start"), F.lit(kind).alias("kind"), e.cast("int").alias("end"), m.alias("found")))
        return F.filter(made, lambda s: long(s["found"]))

    return F.when(F.regexp_like(text, F.lit(pattern)), _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)).otherwise(empty)


def _bare(spans: Column, shift: Column | int = 0) -> Column:
    """Spans without what was found, moved by shift."""
    return F.transform(spans, lambda s: F.struct((s["start"] + shift).alias("start"), s["kind"].alias("kind"), (s["end"] + shift).alias("end")))


def _tail(z: Column) -> Column:
    """Upper tail of the standard normal distribution, by a logistic fit (error below 0.0002)."""
    return 1 / (1 + F.exp(F.least(F.greatest(1.5976 * z + 0.07056 * z * z * z, F.lit(-60.0)), F.lit(60.0))))


def battery(found: Column) -> Column:
    """Struct (encoding, z_uniform, z_runs, z_serial, plain, n, bits, p, bare) of one run of characters; bare: runs without digits for each with, if random."""
    name = F.coalesce(*[F.when(F.regexp_like(found, F.lit("^[" + a.replace("-", r"\-") + "]+$")), F.lit(k)) for k, a in ALPHABETS], F.lit("any"))
    known = F.create_map(*[F.lit(x) for k, a in (*ALPHABETS, ("any", ALPHABETS[-2][1] + "-_")) for x in (k, a)])
    n = F.char_length(found).cast("double")
    zero = F.lit(0.0)

    def placed(e: Column) -> Column:
        places = F.filter(F.transform(F.split(found, ""), lambda c: F.instr(e["alphabet"], c).cast("double")), lambda x: x > 0)
        return _let(places, lambda x: counted(e, x))

    def counted(e: Column, places: Column) -> Column:
        size = F.char_length(e["alphabet"]).cast("double")
        n1 = F.aggregate(places, zero, lambda s, x: s + (x > size / 2).cast("double"))
        center = F.aggregate(places, zero, lambda s, x: s + x) / n
        return _let(F.struct(size.alias("size"), n1.alias("n1"), center.alias("center")), lambda m: summed(e, places, m))

    def summed(e: Column, places: Column, m: Column) -> Column:
        pairs = F.sequence(F.lit(2), F.greatest(F.size(places), F.lit(2)))
        high = lambda i: F.get(places, i) > m["size"] / 2
        squares = F.aggregate(F.split(e["alphabet"], ""), zero, lambda s, c: s + F.pow(n - F.char_length(F.replace(found, c, F.lit(""))), F.lit(2.0)))
        turns = F.aggregate(pairs, F.lit(1.0), lambda s, i: s + F.coalesce((high(i - 1) != high(i - 2)).cast("double"), zero))
        power = F.aggregate(places, zero, lambda s, x: s + (x - m["center"]) * (x - m["center"]))
        cross = F.aggregate(pairs, zero, lambda s, i: s + F.coalesce((F.get(places, i - 1) - m["center"]) * (F.get(places, i - 2) - m["center"]), zero))
        return _let(F.struct(squares.alias("squares"), turns.alias("turns"), power.alias("power"), cross.alias("cross")), lambda q: normal(e, m, q))

    def normal(e: Column, m: Column, q: Column) -> Column:
        df, n0 = m["size"] - 1, n - m["n1"]
        # uniformity: X2 = k/n * sum of squared counts - n, turned normal by Wilson and Hilferty
        z_uniform = (F.pow(F.greatest((m["size"] / n * q["squares"] - n) / df, F.lit(1e-9)), F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
        mean = 2 * m["n1"] * n0 / n + 1
        var = F.greatest((mean - 1) * (mean - 2) / (n - 1), F.lit(1e-9))
        z_runs = F.when((m["n1"] < 2) | (n0 < 2), F.lit(4.0)).otherwise(F.abs(q["turns"] - mean) / F.sqrt(var))
        z_serial = F.abs(q["cross"] / F.greatest(q["power"], F.lit(1e-9)) + 1 / n) * F.sqrt(n)
        return _let(F.struct(z_uniform.alias("u"), z_runs.alias("r"), z_serial.alias("s")), lambda z: result(e, m, z))

    def result(e: Column, m: Column, z: Column) -> Column:
        p = F.least(F.lit(1.0), 3 * F.least(_tail(z["u"]), 2 * _tail(z["r"]), 2 * _tail(z["s"])))
        digits = F.char_length(F.regexp_replace(e["alphabet"], "[^0-9]", "")).cast("double")
        bare = F.pow(1 - digits / m["size"], n)
        fields = {"encoding": e["name"], "z_uniform": z["u"], "z_runs": z["r"], "z_serial": z["s"], "plain": e["plain"], "n": n, "bits": n * F.log2(m["size"]), "p": p, "bare": bare / (1 - bare)}
        return F.struct(*[v.alias(k) for k, v in fields.items()])

    plain = ~F.regexp_like(found, F.lit("[0-9]")) | ~F.regexp_like(found, F.lit("[A-Za-z]"))
    return _let(name, lambda k: _let(F.struct(k.alias("name"), F.element_at(known, k).alias("alphabet"), plain.alias("plain")), placed))


def _pooled(plain: dict[int, list[int]], bare: dict[tuple[str, int], list[float]], length: int) -> tuple[list[int], list[float]]:
    """Plain words by bin, of this length and then of ever farther ones until there are LEAST_PLAIN, and the keys without digits to be expected among them."""
    words, keys = [0] * _BINS, [0.0] * _BINS
    for away in range(max((abs(k - length) for k in plain), default=-1) + 1):
        for k in {length - away, length + away} & set(plain):
            words = [x + y for x, y in zip(words, plain[k])]
            for (_, own), expected in bare.items():
                keys = [x + y for x, y in zip(keys, expected)] if own == k else keys
        if sum(words) >= LEAST_PLAIN:
            break
    return words, keys


def _cuts(runs: DataFrame) -> dict[str, float]:
    """The p-value above which runs are taken for random, by encoding, plainness and length.

    The table behind it has at most ten encodings times eight lengths times two times _BINS rows.
    """
    place = F.least(F.floor(-4 * F.log10(F.greatest("p", F.lit(1e-300)))), F.lit(_BINS - 1)).cast("int")
    rows = runs.groupBy("length", "encoding", "plain", place.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum("bare").alias("bare"), F.count_if("lettered").alias("lettered")).collect()
    blank = lambda: [0] * _BINS
    plain: dict[int, list[int]] = {}
    mixed: dict[tuple[str, int], list[int]] = {}
    bare: dict[tuple[str, int], list[float]] = {}
    lettered: dict[tuple[str, int], list[int]] = {}
    for r in rows:
        key = (r["encoding"], r["length"])
        if r["plain"]:
            plain.setdefault(r["length"], blank())[r["bin"]] += r["n"]
            lettered.setdefault(key, blank())[r["bin"]] += r["lettered"]
        else:
            mixed.setdefault(key, blank())[r["bin"]] += r["n"]
            bare.setdefault(key, blank())[r["bin"]] += r["bare"]
    out: dict[str, float] = {}
    for key, counts in mixed.items():
        total, upto, bound = sum(counts), 0, 8
        for b in reversed(range(_BINS)):
            upto += counts[b]
            if upto and 10 ** (-b / 4) <= REJECT_AT * upto / total:
                bound = min(bound, b)
        structured = sum(counts[bound:])
        words, keys = _pooled(plain, bare, key[1])
        for k in reversed(range(bound)):
            chance = sum(keys[: k + 1])
            passing = max(0.0, sum(words[: k + 1]) - chance - 2 * chance**0.5)
            passing *= structured / max(1.0, passing + sum(words[k + 1 :]))
            mirrored = sum(counts[2 * bound - 1 - k : 2 * bound])
            false = max(passing, mirrored) + 0.5 * structured / (structured + sum(words) + 1)
            kept = sum(counts[: k + 1])
            if kept and false <= FALSE_SHARE * kept:
                out[f"{key[0]}:false:{key[1]}"] = 10 ** (-(k + 1) / 4)
                break
        else:
            continue
        for j in reversed(range(k + 1)):
            expected, found = sum(bare[key][: j + 1]), sum(lettered.get(key, blank())[: j + 1])
            if found and (1 - FALSE_SHARE) * found <= expected + expected**0.5:
                out[f"{key[0]}:true:{key[1]}"] = 10 ** (-(j + 1) / 4)
                break
    return out


_RUN, _BASE, _COUNT = 1, 1 << 20, 1 << 40


def _uncovered(runs: Column, base: Column) -> Column:
    """The parts of runs that no base span covers, as structs (start, end, found), if long enough.

    One sweep over all ends in order: between two neighbouring ends lies a part if a run is open
    there and no base span. What is open is one running sum, with the runs met so far beside it.
    """
    mark = lambda at, what: F.struct(at.alias("at"), F.lit(what).cast("long").alias("what"))
    ends = lambda of, opens, closes: F.concat(F.transform(of, lambda s: mark(s["start"], opens)), F.transform(of, lambda s: mark(s["end"], closes)))
    none = F.array().cast("array<struct<start:int,end:int,found:string>>")

    def swept(marks: Column) -> Column:
        def part(open_: Column, i: Column) -> Column:
            return F.struct(F.get(marks, i)["at"].alias("start"), F.get(marks, i + 1)["at"].alias("end"), open_.alias("open"))

        sections = F.transform(running(F.transform(marks, lambda m: m["what"])), part)
        kept = F.filter(sections, lambda s: (F.pmod(s["open"], F.lit(_COUNT)) == _RUN) & (s["end"] - s["start"] >= _SHORTEST))

        def cut(s: Column) -> Column:
            run = F.get(runs, (F.shiftright(s["open"], 40) - 1).cast("int"))
            return F.struct(s["start"].alias("start"), s["end"].alias("end"), F.substring(run["found"], s["start"] - run["start"] + 1, s["end"] - s["start"]).alias("found"))

        return F.transform(kept, cut)

    marks = F.sort_array(F.concat(ends(runs, _COUNT + _RUN, -_RUN), ends(base, _BASE, -_BASE)))
    return F.when(F.size(runs) > 0, _let(marks, swept)).otherwise(none)


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    A null or empty text has no spans, so empty strings and the checksum of one. Null and
    repeated ids are kept. Spans of one start follow the order of KINDS. Time grows with a text's
    length and matches, by no more. Other columns are ignored, whatever their names. An empty
    table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    found = rows.select("doc_id", spans(F.col("t"), ASSIGN, 0, LEAST_ASSIGNED, 2).alias("assigned"), spans(F.col("t"), CANDIDATE, 3).alias("runs"))
    # access keys and hexadecimal runs lie within candidate runs, whose characters hold theirs
    within = lambda pattern, kind: F.flatten(F.transform("runs", lambda r: _bare(spans(r["found"], pattern, kind), r["start"])))
    based = found.select("doc_id", "runs", F.sort_array(F.concat(_bare(F.col("assigned")), within(ACCESS, 1), within(HEX, 2)).cast(_SPAN)).alias("base"))
    apart = based.select("doc_id", "base", _uncovered(F.col("runs"), F.col("base")).alias("runs"))
    tested = F.transform("runs", lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end"), battery(r["found"]).alias("t"), F.regexp_like(r["found"], F.lit("[A-Za-z]")).alias("lettered")))
    table = materialise(apart.select("doc_id", "base", tested.alias("runs")), "secret-spans")
    length = lambda n: F.least(F.floor(F.log2(n / _SHORTEST) * 2), F.lit(7)).cast("int")
    runs = table.select(F.explode("runs").alias("r")).where(F.col("r.t.bits") >= LEAST_BITS)
    cuts = _cuts(runs.select(F.col("r.t.encoding"), F.col("r.t.plain"), F.col("r.t.p"), F.col("r.t.bare"), F.col("r.lettered"), length(F.col("r.t.n")).alias("length")))
    if cuts:
        cut = F.create_map(*[F.lit(x) for kv in cuts.items() for x in kv])
        like = lambda r: F.concat_ws(":", r["t"]["encoding"], r["t"]["plain"].cast("string"), length(r["t"]["n"]).cast("string"))
        taken = F.filter("runs", lambda r: r["lettered"] & (r["t"]["bits"] >= LEAST_BITS) & F.coalesce(r["t"]["p"] > cut[like(r)], F.lit(False)))
        every = F.sort_array(F.concat("base", F.transform(taken, lambda r: F.struct(r["start"].alias("start"), F.lit(3).alias("kind"), r["end"].alias("end")))))
    else:
        every = F.col("base")
    name = F.array(*[F.lit(k) for k in KINDS])
    text = lambda s: F.array_join(F.transform(s, lambda b: F.concat_ws(":", F.get(name, b["kind"]), b["start"].cast("string"), b["end"].cast("string"))), ",")
    many = lambda k: F.size(F.filter("base", lambda b: b["kind"] == k)).cast("long")
    return table.select("doc_id", many(0).alias("n_assign"), many(1).alias("n_access"), many(2).alias("n_hex"), F.sha2(text(F.col("base")), 256).alias("base_sha256"), text(every).alias("spans"))
