"""Signal kernels on array columns, as higher-order functions: no exploding, no Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessitura.functions.numeric import d


def let(value: Column, body) -> Column:
    """body of a value that is computed once: in a lambda, an expression of the row is computed again for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def scaled(x: Column, by) -> Column:
    """x divided by a number made of its peak; x and the number are computed once."""
    return let(x, lambda y: let(by(peak(y)), lambda k: F.transform(y, lambda v: v / k)))


def total(x: Column, of=lambda v: v) -> Column:
    """Sum in double, in order of the array."""
    return F.aggregate(x, d(0), lambda a, v: a + of(v.cast("double")))


def mean(x: Column, of=lambda v: v) -> Column:
    return F.when(F.size(x) > 0, total(x, of) / F.size(x)).otherwise(d(0))


def rms(x: Column) -> Column:
    return F.sqrt(mean(x, lambda v: v * v))


def share(x: Column, test) -> Column:
    return F.when(F.size(x) > 0, F.size(F.filter(x, test)) / F.size(x).cast("double")).otherwise(d(0))


def silence_ratio(x: Column, below: float = 0.005) -> Column:
    """Share of samples strictly nearer to zero than `below`."""
    return share(x, lambda v: F.abs(v) < F.lit(below).cast("float"))


def clipping_ratio(x: Column, least: float = 0.99) -> Column:
    return share(x, lambda v: F.abs(v) >= F.lit(least).cast("float"))


def crossings(x: Column) -> Column:
    """Number of neighbours on different sides of zero; zero counts as positive."""
    pairs = F.zip_with(F.slice(x, F.lit(1), F.greatest(F.size(x) - 1, F.lit(0))), F.slice(x, F.lit(2), F.greatest(F.size(x) - 1, F.lit(0))), lambda a, b: (a >= 0) != (b >= 0))
    return F.when(F.size(x) > 1, F.size(F.filter(pairs, lambda v: v))).otherwise(0)


def zero_crossing_rate(x: Column, rate: int) -> Column:
    """Crossings a second."""
    return F.when(F.size(x) > 0, crossings(x) * d(rate) / F.size(x)).otherwise(d(0))


def downmix(x: Column, channels: int) -> Column:
    """Mean of interleaved channels; a partial last frame is dropped."""
    n = F.floor(F.size(x) / channels).cast("int")
    frame = lambda i: F.aggregate(F.slice(x, i * channels + 1, F.lit(channels)), d(0), lambda a, v: a + v.cast("double")) / channels
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), frame)).otherwise(F.array().cast("array<double>"))


def resample_linear(x: Column, rate_in: int, rate_out: int) -> Column:
    """floor(n / (rate_in / rate_out)) samples, each between its two neighbours, clamped at the end."""
    step = rate_in / rate_out
    n = F.floor(F.size(x) / d(step)).cast("int")
    at = lambda i: F.least(F.floor(i * d(step)).cast("int"), F.size(x) - 1)
    value = lambda i: F.get(x, at(i)) * (1 - (i * d(step) - at(i))) + F.get(x, F.least(at(i) + 1, F.size(x) - 1)) * (i * d(step) - at(i))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), value)).otherwise(F.array().cast("array<double>"))


def resample_nearest(x: Column, rate_in: int, rate_out: int) -> Column:
    """Stride if rate_in is a multiple, repeats if rate_out is, else the sample at the floored place."""
    n = F.size(x)
    empty = F.slice(x, F.lit(1), F.lit(0))
    if rate_in % rate_out == 0:
        k = rate_in // rate_out
        return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.ceil(n / k).cast("int") - 1), lambda i: F.get(x, i * k))).otherwise(empty)
    if rate_out % rate_in == 0:
        return F.flatten(F.transform(x, lambda v: F.array_repeat(v, rate_out // rate_in)))
    ratio = rate_in / rate_out
    out = F.floor(n / d(ratio)).cast("int")
    return F.when(out > 0, F.transform(F.sequence(F.lit(0), out - 1), lambda i: F.get(x, F.least(F.floor(i * d(ratio)).cast("int"), n - 1)))).otherwise(empty)


def trim_or_tile(x: Column, n: int) -> Column:
    """The first n samples of x repeated as often as needed."""
    return F.when(F.size(x) > 0, F.slice(F.flatten(F.array_repeat(x, F.ceil(F.lit(n) / F.size(x)).cast("int"))), 1, n)).otherwise(x)


def zero_pad(x: Column, n: int) -> Column:
    return F.slice(F.concat(x, F.array_repeat(F.lit(0.0), n).cast("array<double>")), 1, n)


def peak(x: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(x, F.abs)), d(0))


def mix_at_snr(speech: Column, noise: Column, snr_db: Column) -> Column:
    """Noise scaled to the ratio of energies and added; divided by the peak where it exceeds 1."""
    gain = rms(speech) / F.pow(d(10), snr_db / d(20)) / (rms(noise) + d(1e-9))
    both = let(gain, lambda g: F.zip_with(speech, noise, lambda a, b: a.cast("double") + b.cast("double") * g))
    return scaled(both, lambda p: F.greatest(d(1), p))


def mix_with_headroom(speech: Column, noise: Column, snr_db: Column) -> Column:
    """As mix_at_snr, but silent speech stays, and peaks above 0.98 are scaled to 0.95."""
    gain = rms(speech) / F.pow(d(10), snr_db / d(20)) / F.greatest(rms(noise), d(1e-9))
    both = let(gain, lambda g: F.zip_with(speech, noise, lambda a, b: a.cast("double") + b.cast("double") * g))
    scale = lambda p: F.when(p > 0.98, d(0.95) / p).otherwise(d(1))
    held = let(both, lambda y: let(scale(peak(y)), lambda k: F.transform(y, lambda v: v * k)))
    return F.when(rms(speech) < 1e-9, F.transform(speech, lambda v: v.cast("double"))).otherwise(held)


def convolve(x: Column, h: Column) -> Column:
    """The first size(x) values of the full convolution, divided by the peak if that is above 1e-6."""
    return let(x, lambda a: let(h, lambda b: _convolve(a, b)))


def _convolve(x: Column, h: Column) -> Column:
    one = lambda i: F.aggregate(F.sequence(F.lit(0), F.least(i, F.size(h) - 1)), d(0), lambda a, k: a + F.get(x, i - k).cast("double") * F.get(h, k).cast("double"))
    y = F.transform(F.sequence(F.lit(0), F.size(x) - 1), one)
    return F.when(F.size(x) == 0, F.array().cast("array<double>")).otherwise(scaled(y, lambda p: F.when(p > 1e-6, p).otherwise(d(1))))


def clip(x: Column, level: float, normalise: bool = True) -> Column:
    """Samples held within +-level; then divided by the peak."""
    held = F.transform(x, lambda v: F.greatest(d(-level), F.least(d(level), v.cast("double"))))
    return scaled(held, lambda p: F.when(p > 0, p).otherwise(d(1))) if normalise else held


def drive(x: Column, level: float) -> Column:
    """Samples over level, held within +-1, times level."""
    return F.transform(x, lambda v: F.greatest(d(-1), F.least(d(1), v.cast("double") / d(level))) * d(level))


def low_utility(x: Column, tail: int, gain: float = 0.05) -> Column:
    """The last `tail` samples, quietened, in front; zeros after."""
    k = F.least(F.lit(tail), F.size(x))
    return F.concat(F.transform(F.slice(x, F.size(x) - k + 1, k), lambda v: v.cast("double") * d(gain)), F.array_repeat(d(0), F.size(x) - k))


def chunks(x: Column, length: int, hop: int = 0) -> Column:
    """Array of (idx, start, samples) of length samples every hop (0: length); the last may be shorter."""
    hop = hop or length
    starts = F.when(F.size(x) > 0, F.sequence(F.lit(0), F.size(x) - 1, F.lit(hop))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda s, i: F.struct(i.alias("idx"), s.alias("start"), F.slice(x, s + 1, F.lit(length)).alias("samples")))


def frames(x: Column, size: int, hop: int) -> Column:
    """Array of (frame, samples): whole frames only."""
    starts = F.when(F.size(x) >= size, F.sequence(F.lit(0), F.size(x) - size, F.lit(hop))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda s, i: F.struct(i.alias("frame"), F.slice(x, s + 1, F.lit(size)).alias("samples")))


def eval_chunks(x: Column, seconds: float, rate: int, drop_short: bool = False) -> Column:
    """Chunks of so many whole samples without overlap; drop_short leaves out those below half of that. Less than a sample: one chunk of all."""
    length = int(seconds * rate)
    if length > 0:
        out = chunks(x, length)
        return F.filter(out, lambda c: F.size(c["samples"]) >= length // 2) if drop_short else out
    if drop_short:
        raise ValueError("a chunk must hold a sample")
    return F.array(F.struct(F.lit(0).alias("idx"), F.lit(0).alias("start"), x.alias("samples")))


def slice_seconds(x: Column, start: Column, stop: Column, rate: int) -> Column:
    """Samples of a segment: places cut down to whole samples and to the signal; none where nothing is left."""
    first = F.greatest(F.lit(0), (start * rate).cast("int"))
    return F.slice(x, first + 1, F.greatest(F.lit(0), F.least(F.size(x), (stop * rate).cast("int")) - first))


def sign_change_rate(x: Column, rate: int) -> Column:
    """Changes of sign a second, zero being a sign of its own."""
    n = F.greatest(F.size(x) - 1, F.lit(0))
    changed = F.zip_with(F.slice(x, F.lit(1), n), F.slice(x, F.lit(2), n), lambda a, b: F.signum(a.cast("double")) != F.signum(b.cast("double")))
    return F.when(F.size(x) > 0, F.size(F.filter(changed, lambda v: v)) * d(rate) / F.size(x)).otherwise(d(0))
