"""Text, path and identity expressions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: What is neither letter, number, underscore nor apostrophe: signs and white space alike.
BETWEEN_WORDS = r"[^\p{L}\p{N}_']+"


def normalise(text: Column) -> Column:
    """Lower case; runs of anything but letters, numbers, underscore and apostrophe become one space, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(text), BETWEEN_WORDS, " "))


def words(text: Column) -> Column:
    """Words of normalised text; none if it is empty."""
    return F.when(F.length(text) > 0, F.split(text, " ")).otherwise(F.array().cast("array<string>"))


#: What Python's str.split() splits at.
BLANK = r"[\s\x0B\x1C-\x1F\x85\p{Z}]+"


def plain_words(text: Column) -> Column:
    """Lower-cased words between white space, signs left in place; none of a null."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), BLANK), lambda w: w != "")


def word_errors_sql(ref: Column, hyp: Column) -> Column:
    """Least substitutions, deletions and insertions between two word arrays: a fold over rows of the distance table."""
    first = F.sequence(F.lit(0), F.size(hyp))

    def row(before: Column, word: Column) -> Column:
        start = F.array(F.get(before, F.lit(0)) + 1)
        cell = lambda acc, j: F.concat(acc, F.array(F.least(F.get(before, j) + 1, F.element_at(acc, -1) + 1, F.get(before, j - 1) + (F.get(hyp, j - 1) != word).cast("int"))))
        return F.when(F.size(hyp) == 0, start).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(hyp), F.lit(1))), start, cell))

    return F.element_at(F.aggregate(ref, first, row), -1)


#: Cells of the rows of distance tables that are computed at once.
CELLS = 1 << 14


def _counts(a: np.ndarray, a_at: np.ndarray, b: np.ndarray, b_at: np.ndarray) -> np.ndarray:
    """(matches, substitutions, deletions, insertions) of pairs of equal offsets: numbers of words a[a_at[k]:a_at[k + 1]] against b's.

    The way back prefers match, substitution, deletion, insertion. A cell's way is that of the cell it comes from and one step, so
    two rows hold it, with errors and matches; the other kinds follow from the lengths. Pairs alike in length go together.
    """
    n, m = np.diff(a_at), np.diff(b_at)
    out = np.zeros((len(n), 4), dtype=np.int64)
    order = np.lexsort((m, n // 32))
    first = 0
    while first < len(order):
        group = order[first : first + max(1, CELLS // (int(m[order[first]]) + 1))]
        widths = np.maximum.accumulate(m[group]) + 1
        group = group[: max(1, int(np.count_nonzero(widths * np.arange(1, len(group) + 1) <= CELLS)))]
        first += len(group)
        rows, columns = int(n[group].max()), int(m[group].max())
        x, y = np.full((len(group), rows), -1, dtype=np.int32), np.full((len(group), columns), -2, dtype=np.int32)
        for k, g in enumerate(group):
            x[k, : n[g]], y[k, : m[g]] = a[a_at[g] : a_at[g + 1]], b[b_at[g] : b_at[g + 1]]
        step = np.arange(columns + 1, dtype=np.int32)
        errors, same = np.tile(step, (len(group), 1)), np.zeros((len(group), columns + 1), dtype=np.int32)
        best, base, source = np.empty_like(errors), np.empty_like(same), np.zeros((len(group), columns + 1), dtype=np.int32)
        at = np.arange(len(group))[:, None]
        for i in range(rows + 1):
            if i:
                equal = y == x[:, i - 1 : i]
                across, down = errors[:, :-1] + ~equal, errors[:, 1:] + 1
                best[:, 0] = i
                np.minimum(across, down, out=best[:, 1:])
                errors = np.minimum.accumulate(best - step, axis=1) + step
                diagonal, above = errors[:, 1:] == across, errors[:, 1:] == down
                base[:, 0] = 0
                base[:, 1:] = np.where(diagonal, same[:, :-1] + equal, same[:, 1:])
                source[:, 1:] = np.where(diagonal | above, step[1:], 0)
                same = base[at, np.maximum.accumulate(source, axis=1)]
            for k in np.flatnonzero(n[group] == i):
                g = group[k]
                e, s = int(errors[k, m[g]]), int(same[k, m[g]])
                inserted = e - (int(n[g]) - s)
                replaced = int(m[g]) - s - inserted
                out[g] = s, replaced, int(n[g]) - s - replaced, inserted
    return out


def align_counts(ref: list[str], hyp: list[str]) -> tuple[int, int, int, int]:
    """(matches, substitutions, deletions, insertions), the way back preferring match, substitution, deletion, insertion."""
    ids: dict[str, int] = {}
    a, b = (np.array([ids.setdefault(w, len(ids)) for w in words], dtype=np.int32) for words in (ref, hyp))
    return tuple(_counts(a, np.array([0, len(a)]), b, np.array([0, len(b)]))[0].tolist())


_COUNTS = ("matches", "substitutions", "deletions", "insertions")
#: Words, of ref and hyp together, that are numbered at once.
WORDS = 1 << 18


def _flat(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Values of a list column and its offsets in them; a null has none."""
    return column.flatten(), np.concatenate([[0], np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)


@F.arrow_udf(T.StructType([T.StructField(c, T.IntegerType()) for c in _COUNTS]))
def alignment(ref: pa.Array, hyp: pa.Array) -> pa.Array:
    """align_counts of word arrays, a slice of rows at a time; words are numbered by Arrow and never become Python's."""
    (a, a_at), (b, b_at) = _flat(ref), _flat(hyp)
    total, out, start = a_at + b_at, [np.zeros((0, 4), dtype=np.int64)], 0
    while start < len(ref):
        stop = max(start + 1, int(np.searchsorted(total, total[start] + WORDS, side="right")) - 1)
        x, y = a.slice(a_at[start], a_at[stop] - a_at[start]), b.slice(b_at[start], b_at[stop] - b_at[start])
        ids = pa.concat_arrays([x, y]).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        out.append(_counts(ids[: len(x)], a_at[start : stop + 1] - a_at[start], ids[len(x) :], b_at[start : stop + 1] - b_at[start]))
        start = stop
    counts = np.concatenate(out)
    return pa.StructArray.from_arrays([pa.array(counts[:, i].astype(np.int32)) for i in range(4)], list(_COUNTS))


def clean_path(path: Column) -> Column:
    """Lexical normal form: no empty or `.` parts, `..` takes away the part before it, a leading slash stays."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    rooted = F.startswith(path, F.lit("/"))
    up = F.lit("..")
    fold = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, p: F.when((p == up) & (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1)) != up), F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).when((p == up) & rooted, acc).otherwise(F.concat(acc, F.array(p))),
    )
    return F.concat(F.when(rooted, "/").otherwise(""), F.array_join(fold, "/"))


def canonical_source(path: Column, roots: dict[str, str], logical: str = "data/raw/") -> Column:
    """A path's identity: the part from `logical` on where it has one, else the longest physical root replaced by its logical root; null outside all roots."""
    clean = clean_path(path)
    at = F.instr(clean, logical)
    out = F.when(at > 0, F.substr(clean, at))
    for physical in sorted(roots, key=lambda r: (-len(r), r)):
        root = physical.rstrip("/") + "/"
        out = out.when(F.startswith(clean, F.lit(root)), F.concat(F.lit(roots[physical].rstrip("/") + "/"), F.substr(clean, F.lit(len(root) + 1))))
    return out.otherwise(F.lit(None).cast("string"))


def portable(value: Column, root: str, roots: dict[str, str]) -> Column:
    """A reference that names no host folder: paths (values with a slash) from root on, else their source identity; other values as they are, null as empty."""
    root = root.rstrip("/") + "/"
    whole = clean_path(F.when(F.startswith(value, F.lit("/")), value).otherwise(F.concat(F.lit(root), value)))
    path = F.when(F.startswith(whole, F.lit(root)), F.substr(whole, F.lit(len(root) + 1))).otherwise(canonical_source(whole, roots))
    return F.when(F.coalesce(value, F.lit("")) == "", "").when(F.instr(value, "/") > 0, path).otherwise(value)


def input_identities(source: Column, corruption: Column, roots: dict[str, str]) -> Column:
    """Sorted distinct identities of all an example was made of: its source, and its corruption where that is a path."""
    of = F.array(F.when(source != "", canonical_source(source, roots)), F.when(F.instr(corruption, "/") > 0, canonical_source(corruption, roots)))
    return F.array_sort(F.array_distinct(F.array_compact(of)))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def model_name(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(base_name(path), r"^ggml-", ""), r"\.bin$", "")


def build_label(name: Column) -> Column:
    return F.nullif(F.regexp_extract(name, r"__(std|opt|prof)__", 1), F.lit(""))


def quantisation(name: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(name, r"(q\d+[_k]?\d*)", 1), F.lit("")), F.lit("f16"))


def key_values(line: Column, sep: str = "\t") -> Column:
    """Map of key=value tokens, split at the first `=`; tokens without it are dropped, of equal keys the last holds."""
    tokens = F.filter(F.split(line, sep), lambda t: F.instr(t, "=") > 0)
    pairs = F.transform(tokens, lambda t: F.struct(F.substring_index(t, "=", 1).alias("key"), F.substr(t, F.instr(t, "=") + 1).alias("value")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(last)


def ascii_json(json: Column) -> Column:
    """JSON with every character beyond ASCII as an escape of four hex digits, or two of them beyond the first plane."""
    code = lambda n: F.concat(F.lit("\\u"), F.lower(F.lpad(F.hex(n), 4, "0")))
    high = lambda n: n - 0x10000
    pair = lambda n: F.concat(code(F.shiftright(high(n), 10) + 0xD800), code(high(n).bitwiseAND(F.lit(1023)) + 0xDC00))
    escaped = F.array_join(F.transform(F.split(json, ""), lambda c: F.when(F.ascii(c) < 128, c).when(F.ascii(c) < 0x10000, code(F.ascii(c))).otherwise(pair(F.ascii(c)))), "")
    return F.when(json.rlike(r"[^\x00-\x7F]"), escaped).otherwise(json)


def example_json(label: Column, source: Column, corruption_source: Column, snr_db: Column, rir_id: Column, generation_params: Column, duration_sec: Column, sample_rate: Column) -> Column:
    """The eight fields of an example as canonical JSON: keys in order, no spaces, ASCII only. Null texts are empty, null maps too; null numbers stay null.

    source and corruption_source are identities already (canonical_source); generation_params is a map of texts.
    """
    blank = lambda c: F.coalesce(c, F.lit(""))
    params = F.map_from_entries(F.array_sort(F.map_entries(F.coalesce(generation_params, F.create_map().cast("map<string,string>")))))
    fields = {"corruption_source": blank(corruption_source), "duration_sec": duration_sec, "generation_params": params, "label": blank(label), "rir_id": blank(rir_id), "sample_rate": sample_rate, "snr_db": snr_db, "source": blank(source)}
    return ascii_json(F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]), {"ignoreNullFields": "false"}))


def example_id(json: Column) -> Column:
    return F.substr(F.sha2(json, 256), F.lit(1), F.lit(24))


def identity(*parts: Column) -> Column:
    """First 24 hex digits of the SHA-256 of a canonical JSON of the parts."""
    return F.substr(F.sha2(F.to_json(F.struct(*parts), {"ignoreNullFields": "false"}), 256), F.lit(1), F.lit(24))
