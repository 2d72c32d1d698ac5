"""Colour expressions: parsing, CIE Lab (D65), CIE76 and CIEDE2000 differences, colour classes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_hex(text: Column) -> Column:
    """``#rgb``, ``#rrggbb`` or ``#rrggbbaa`` as struct<r, g, b, a>; null if it is none of them."""
    t = F.lower(F.trim(text))
    short = F.regexp_replace(t, "^#(.)(.)(.)$", "#$1$1$2$2$3$3")
    full = F.when(t.rlike("^#[0-9a-f]{3}$"), short).when(t.rlike("^#([0-9a-f]{6}|[0-9a-f]{8})$"), t)
    part = lambda k: F.conv(F.substring(full, k, 2), 16, 10).cast("int")
    alpha = F.when(F.length(full) == 9, part(8) / F.lit(255.0)).otherwise(F.lit(1.0))
    return F.when(full.isNotNull(), F.struct(part(2).alias("r"), part(4).alias("g"), part(6).alias("b"), alpha.alias("a")))


def parse_css(text: Column) -> Column:
    """``rgb(r, g, b)``, ``rgba(r, g, b, a)`` or a hex colour as struct<r, g, b, a>; null if it is none of them.

    Parts are cut to 0..255, alphas to 0..1; a missing alpha is 1.
    """
    t = F.lower(F.trim(text))
    number = r"\s*(-?[0-9]*\.?[0-9]+)\s*"
    pattern = rf"^rgba?\({number},{number},{number}(?:,{number})?\)$"
    part = lambda k: F.greatest(F.lit(0), F.least(F.lit(255), F.round(F.regexp_extract(t, pattern, k).try_cast("double")))).cast("int")
    alpha = F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.regexp_extract(t, pattern, 4).try_cast("double"))), F.lit(1.0))
    return F.when(t.rlike(pattern), F.struct(part(1).alias("r"), part(2).alias("g"), part(3).alias("b"), alpha.alias("a"))).otherwise(parse_hex(text))


def to_hex(r: Column, g: Column, b: Column) -> Column:
    return F.lower(F.format_string("#%02x%02x%02x", r.cast("int"), g.cast("int"), b.cast("int")))


def _linear(v: Column) -> Column:
    u = v / F.lit(255.0)
    return F.when(u <= 0.04045, u / 12.92).otherwise(F.pow((u + 0.055) / 1.055, F.lit(2.4)))


def _curve(t: Column) -> Column:
    return F.when(t > 216 / 24389, F.cbrt(t)).otherwise((t * (24389 / 27) + 16) / 116)


def lab(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """CIE L*, a*, b* of an sRGB colour (D65 white)."""
    lr, lg, lb = _linear(r), _linear(g), _linear(b)
    fx = _curve((lr * 0.4124564 + lg * 0.3575761 + lb * 0.1804375) / 0.95047)
    fy = _curve(lr * 0.2126729 + lg * 0.7151522 + lb * 0.0721750)
    fz = _curve((lr * 0.0193339 + lg * 0.1191920 + lb * 0.9503041) / 1.08883)
    return fy * 116 - 16, (fx - fy) * 500, (fy - fz) * 200


def luminance(r: Column, g: Column, b: Column) -> Column:
    """Relative luminance of an sRGB colour."""
    return _linear(r) * 0.2126 + _linear(g) * 0.7152 + _linear(b) * 0.0722


def delta76(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    return F.sqrt(sum((x - y) * (x - y) for x, y in zip(a, b, strict=True)))


def let(body: Callable[[Column], Column], **values: Column) -> Column:
    """``body`` of a struct of values that are computed once however often it uses them."""
    return F.transform(F.array(F.struct(*[v.alias(k) for k, v in values.items()])), body)[0]


def delta2000(one: tuple[Column, ...], two: tuple[Column, ...]) -> Column:
    """CIEDE2000 with unit weights."""
    cos = lambda angle: F.cos(F.radians(angle))
    hue = lambda b, a: F.when((a == 0) & (b == 0), 0.0).otherwise((F.degrees(F.atan2(b, a)) + 360) % 360)

    def stretched(s: Column) -> Column:
        mean_c7 = F.pow((F.sqrt(s["a1"] * s["a1"] + s["b1"] * s["b1"]) + F.sqrt(s["a2"] * s["a2"] + s["b2"] * s["b2"])) / 2, F.lit(7.0))
        return let(polar, **_fields(s, "l1", "b1", "l2", "b2"), a1=s["a1"], a2=s["a2"], g=(1 - F.sqrt(mean_c7 / (mean_c7 + 25.0**7))) * 0.5 + 1)

    def polar(s: Column) -> Column:
        p1, p2 = s["a1"] * s["g"], s["a2"] * s["g"]
        chroma = lambda p, b: F.sqrt(p * p + b * b)
        return let(means, **_fields(s, "l1", "l2"), c1=chroma(p1, s["b1"]), c2=chroma(p2, s["b2"]), h1=hue(s["b1"], p1), h2=hue(s["b2"], p2))

    def means(s: Column) -> Column:
        grey, turn, total = s["c1"] * s["c2"] == 0, s["h2"] - s["h1"], s["h1"] + s["h2"]
        dh = F.when(grey, 0.0).when(turn > 180, turn - 360).when(turn < -180, turn + 360).otherwise(turn)
        mh = F.when(grey, total).when(F.abs(turn) <= 180, total / 2).when(total < 360, (total + 360) / 2).otherwise((total - 360) / 2)
        return let(result, dl=s["l2"] - s["l1"], dc=s["c2"] - s["c1"], dh=F.sqrt(s["c1"] * s["c2"]) * 2 * F.sin(F.radians(dh) / 2), mh=mh, mc=(s["c1"] + s["c2"]) / 2, off=(s["l1"] + s["l2"]) / 2 - 50)

    def result(s: Column) -> Column:
        t = 1 - cos(s["mh"] - 30) * 0.17 + cos(s["mh"] * 2) * 0.24 + cos(s["mh"] * 3 + 6) * 0.32 - cos(s["mh"] * 4 - 63) * 0.20
        mc7 = F.pow(s["mc"], F.lit(7.0))
        rt = -F.sqrt(mc7 / (mc7 + 25.0**7)) * 2 * F.sin(F.radians(F.exp(-F.pow((s["mh"] - 275) / 25, F.lit(2.0))) * 60))
        x = s["dl"] / (s["off"] * s["off"] * 0.015 / F.sqrt(s["off"] * s["off"] + 20) + 1)
        return let(lambda v: F.sqrt(v["x"] * v["x"] + v["y"] * v["y"] + v["z"] * v["z"] + v["rt"] * v["y"] * v["z"]), x=x, y=s["dc"] / (s["mc"] * 0.045 + 1), z=s["dh"] / (s["mc"] * 0.015 * t + 1), rt=rt)

    return let(stretched, **{f"{n}{i}": v.cast("double") for i, colour in ((1, one), (2, two)) for n, v in zip("lab", colour, strict=True)})


def _fields(s: Column, *names: str) -> dict[str, Column]:
    return {n: s[n] for n in names}


def blend_fit(colour: tuple[Column, ...], own: tuple[Column, ...], back: tuple[Column, ...]) -> tuple[Column, Column]:
    """Alpha in [0, 1] with which ``own`` over ``back`` comes nearest to ``colour``, and the distance left."""
    span = [o - b for o, b in zip(own, back, strict=True)]
    norm = sum(s * s for s in span)
    dot = sum((c - b) * s for c, b, s in zip(colour, back, span, strict=True))
    alpha = F.when(norm > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot / norm))).otherwise(F.lit(0.0))
    rest = F.sqrt(sum((c - b - s * alpha) * (c - b - s * alpha) for c, b, s in zip(colour, back, span, strict=True)))
    return alpha, rest
