"""Vegetation index registries: every index is one SQL expression over band columns.

A formula takes ``d``, the division of the engine it is written for, and names
the bands b, g, r, e (red edge) and n (near infrared).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BANDS = ("b", "g", "r", "e", "n")
Formula = Callable[[Callable[[str, str], str]], str]


@dataclass(frozen=True)
class Index:
    name: str
    tier: int
    formula: Formula

    def sql(self, divide: Callable[[str, str], str]) -> str:
        return self.formula(divide)


def spark_divide(a: str, b: str) -> str:
    """NULL on a zero denominator."""
    return f"try_divide(({a}), ({b}))"


def nd(a: str, b: str) -> Formula:
    return lambda d: d(f"{a} - {b}", f"{a} + {b}")


def ratio(a: str, b: str) -> Formula:
    return lambda d: d(a, b)


_CHL = "(e - r) - 0.2 * (e - g)"
_OSAVI: Formula = lambda d: f"1.16 * {d('n - r', 'n + r + 0.16')}"
_TCARI: Formula = lambda d: f"3 * ((e - r) - 0.2 * (e - g) * {d('e', 'r')})"
_MCARI: Formula = lambda d: f"({_CHL}) * {d('e', 'r')}"
_MSAVI = "(2 * n + 1) * (2 * n + 1) - 8 * (n - r)"

# Zero denominators and negative roots give NULL.
EXACT: dict[str, tuple[int, Formula]] = {
    "ndvi": (1, nd("n", "r")),
    "ndre": (1, nd("n", "e")),
    "gndvi": (1, nd("n", "g")),
    "cire": (1, lambda d: f"{d('n', 'e')} - 1"),
    "cigreen": (1, lambda d: f"{d('n', 'g')} - 1"),
    "osavi": (1, _OSAVI),
    "evi": (1, lambda d: f"2.5 * {d('n - r', 'n + 6 * r - 7.5 * b + 1')}"),
    "evi2": (1, lambda d: f"2.5 * {d('n - r', 'n + 2.4 * r + 1')}"),
    "ccci": (1, lambda d: d(d("n - e", "n + e"), d("n - r", "n + r"))),
    "mtci": (2, lambda d: d("n - e", "e - r")),
    "datt": (2, lambda d: d("n - e", "n - r")),
    "savi": (2, lambda d: f"1.5 * {d('n - r', 'n + r + 0.5')}"),
    "wdrvi": (2, lambda d: d("0.2 * n - r", "0.2 * n + r")),
    "sipi": (2, lambda d: d("n - b", "n - r")),
    "psri": (2, lambda d: d("r - g", "e")),
    "ari": (2, lambda d: f"{d('1', 'g')} - {d('1', 'e')}"),
    "tcari": (2, _TCARI),
    "mcari": (2, _MCARI),
    "tcari_osavi": (2, lambda d: d(_TCARI(d), _OSAVI(d))),
    "mcari_osavi": (2, lambda d: d(_MCARI(d), _OSAVI(d))),
    "sr": (3, ratio("n", "r")),
    "dvi": (3, lambda d: "n - r"),
    "rdvi": (3, lambda d: f"case when n + r > 0 then {d('n - r', 'sqrt(n + r)')} end"),
    "rendvi": (3, nd("e", "r")),
    "lci": (3, lambda d: d("n - e", "n + r")),
    "cvi": (3, lambda d: d("n * r", "g * g")),
    "npci": (3, nd("r", "b")),
    "ngrdi": (3, nd("g", "r")),
    "tgi": (3, lambda d: "-0.5 * (218 * (r - g) - 108 * (r - b))"),
    "arvi": (3, lambda d: d("n - (2 * r - b)", "n + (2 * r - b)")),
    "bndvi": (3, nd("n", "b")),
    "grndvi": (3, lambda d: d("n - (g + r)", "n + g + r")),
    "msr": (3, lambda d: f"case when {d('n', 'r')} > -1 then {d(d('n', 'r') + ' - 1', 'sqrt(' + d('n', 'r') + ' + 1)')} end"),
    "nli": (3, lambda d: d("n * n - r", "n * n + r")),
    "nirv": (3, lambda d: f"n * {d('n - r', 'n + r')}"),
    "msavi2": (3, lambda d: f"case when {_MSAVI} >= 0 then (2 * n + 1 - sqrt({_MSAVI})) / 2 end"),
    "vari": (3, lambda d: d("g - r", "g + r - b")),
    "gli": (3, lambda d: d("2 * g - r - b", "2 * g + r + b")),
    "srre": (3, ratio("n", "e")),
    "rtvicore": (3, lambda d: "100 * (n - e) - 10 * (n - g)"),
    "cri700": (3, lambda d: f"{d('1', 'b')} - {d('1', 'e')}"),
    "bgi": (3, ratio("b", "g")),
    "rgri": (3, ratio("r", "g")),
    "srpi": (3, ratio("b", "r")),
}

EPS = "1e-8"


def _end(a: str, b: str) -> str:
    return f"(({a}) - ({b})) / (({a}) + ({b}) + {EPS})"


def _erat(a: str, b: str) -> str:
    return f"(({a}) / (({b}) + {EPS}))"


_ECHL = f"({_CHL}) * {_erat('e', 'r')}"
_ECCC = f"({_end('n', 'e')}) / ({_end('n', 'r')} + {EPS})"
_EARI = f"(1 / ((g + {EPS}) + {EPS})) - (1 / ((e + {EPS}) + {EPS}))"

# A small constant in every denominator; values are clipped to -10 .. 10 and never missing.
PADDED: dict[str, str] = {
    "ndvi": _end("n", "r"),
    "gndvi": _end("n", "g"),
    "ndre": _end("n", "e"),
    "bndvi": _end("n", "b"),
    "savi": f"1.5 * (n - r) / (n + r + 0.5 + {EPS})",
    "evi": f"2.5 * (n - r) / (n + 6 * r - 7.5 * b + 1 + {EPS})",
    "evi2": f"2.5 * (n - r) / (n + 2.4 * r + 1 + {EPS})",
    "osavi": f"1.16 * (n - r) / (n + r + 0.16 + {EPS})",
    "msr": f"({_erat('n', 'r')} - 1) / (sqrt({_erat('n', 'r')} + {EPS}) + {EPS})",
    "cigreen": f"{_erat('n', 'g')} - 1",
    "cire": f"{_erat('n', 'e')} - 1",
    "ccci": _ECCC,
    "psri": f"(r - b) / (e + {EPS})",
    "mcari": _ECHL,
    "tcari": f"3 * ((e - r) - 0.2 * (e - g) * {_erat('e', 'r')})",
    "mcari_osavi": f"{_ECHL} / (1.16 * (n - r) / (n + r + 0.16 + {EPS}) + {EPS})",
    "rdvi": f"(n - r) / sqrt(n + r + {EPS})",
    "wdrvi": f"(0.1 * n - r) / (0.1 * n + r + {EPS})",
    "grndvi": _end("n", "g + r"),
    "tgi": "g - 0.39 * r - 0.61 * b",
    "gli": f"(2 * g - r - b) / (2 * g + r + b + {EPS})",
    "vari": f"(g - r) / (g + r - b + {EPS})",
    "ngrdi": _end("g", "r"),
    "sr": _erat("n", "r"),
    "srre": _erat("n", "e"),
    "dvi": "n - r",
    "ndvi_re": _end("e", "r"),
    "lswi": _end("n", "e"),
    "mtci": f"(n - e) / (e - r + {EPS})",
    "ireci": f"(n - r) / ({_erat('e', 'g')} + {EPS})",
    "nli": f"(n * n - r) / (n * n + r + {EPS})",
    "msrre": f"({_erat('n', 'e')} - 1) / (sqrt({_erat('n', 'e')} + {EPS}) + {EPS})",
    "rtvicore": "100 * (n - e) - 10 * (n - g)",
    "cri700": _EARI,
    "ari": _EARI,
    "srpi": _erat("b", "r"),
    "npci": f"(r - b) / (r + b + {EPS})",
    "bgi": _erat("b", "g"),
    "gi": _erat("g", "r"),
    "datt": _ECCC,
    "rgri": _erat("r", "g"),
    "ndvi_blue": _end("n", "b"),
    "nirv": f"({_end('n', 'r')}) * n",
}

#: Twelve indices for image channels: exact zero tests, clipped to -5 .. 5, missing as 0.
CHANNELS = ("ndre", "ccci", "msavi2", "mcari", "tcari_osavi", "srpi", "ari", "mcari_osavi", "npci", "datt", "cri700", "cire")


def registry() -> list[Index]:
    return [Index(k, tier, f) for k, (tier, f) in EXACT.items()]


def with_indices(df: DataFrame, tiers: tuple[int, ...] = (1, 2, 3), names: tuple[str, ...] | None = None) -> DataFrame:
    """Add the indices of ``names``, or else of ``tiers``; ``df`` has the columns b, g, r, e, n."""
    chosen = [i for i in registry() if (i.name in names if names is not None else i.tier in tiers)]
    return df.withColumns({i.name: F.expr(i.sql(spark_divide)) for i in chosen})


def clipped(value: Column, limit: float) -> Column:
    """Within +-limit, missing as 0."""
    return F.greatest(F.lit(-limit), F.least(F.lit(limit), F.coalesce(F.nanvl(value, F.lit(None).cast("double")), F.lit(0.0))))


def with_padded_indices(df: DataFrame) -> DataFrame:
    return df.withColumns({k: clipped(F.expr(f), 10.0) for k, f in PADDED.items()})


def with_channel_indices(df: DataFrame) -> DataFrame:
    return df.withColumns({k: clipped(F.expr(EXACT[k][1](spark_divide)), 5.0) for k in CHANNELS})


# Narrow-band indices, (group, wavelengths, formula over w<nm>).
NARROW: dict[str, tuple[str, tuple[int, ...], Formula]] = {
    "mnd705": ("chl", (750, 705, 445), lambda d: d("w750 - w705", "w750 + w705 - 2 * w445")),
    "vog1": ("chl", (740, 720), lambda d: d("w740", "w720")),
    "vog2": ("chl", (734, 747, 715, 726), lambda d: d("w734 - w747", "w715 + w726")),
    "chl_re": ("chl", (750, 710), lambda d: f"{d('w750', 'w710')} - 1"),
    "dd": ("chl", (749, 720, 701, 672), lambda d: "(w749 - w720) - (w701 - w672)"),
    "mcari_narrow": ("chl", (700, 670, 550), lambda d: f"((w700 - w670) - 0.2 * (w700 - w550)) * {d('w700', 'w670')}"),
    "tcari_narrow": ("chl", (700, 670, 550), lambda d: f"3 * ((w700 - w670) - 0.2 * (w700 - w550) * {d('w700', 'w670')})"),
    "osavi_narrow": ("chl", (800, 670), lambda d: f"1.16 * {d('w800 - w670', 'w800 + w670 + 0.16')}"),
    "tcari_osavi_narrow": ("chl", (700, 670, 550, 800), lambda d: d(f"3 * ((w700 - w670) - 0.2 * (w700 - w550) * {d('w700', 'w670')})", f"1.16 * {d('w800 - w670', 'w800 + w670 + 0.16')}")),
    "zm": ("chl", (750, 710), lambda d: d("w750", "w710")),
    "gi_narrow": ("chl", (554, 677), lambda d: d("w554", "w677")),
    "pri": ("stress", (531, 570), lambda d: d("w531 - w570", "w531 + w570")),
    "sipi_narrow": ("stress", (800, 445, 680), lambda d: d("w800 - w445", "w800 - w680")),
    "cri550": ("stress", (510, 550), lambda d: f"{d('1', 'w510')} - {d('1', 'w550')}"),
    "ari_narrow": ("stress", (550, 700), lambda d: f"{d('1', 'w550')} - {d('1', 'w700')}"),
    "psri_narrow": ("stress", (678, 500, 750), lambda d: d("w678 - w500", "w750")),
    "wbi": ("water", (900, 970), lambda d: d("w900", "w970")),
    "ndwi_hyper": ("water", (860, 1020), lambda d: d("w860 - w1020", "w860 + w1020")),
    "msi": ("water", (819, 1020), lambda d: d("w819", "w1020")),
    "r_fe": ("micro", (700, 670, 750, 550), lambda d: d("w700 - w670", "w750 - w550")),
    "r_mn": ("micro", (741, 720), lambda d: d("w741 - w720", "w741 + w720")),
    "r_zn": ("micro", (903, 860), lambda d: d("w903 - w860", "w903 + w860")),
    "r_ca": ("micro", (798, 750), lambda d: d("w798", "w750")),
}


def band_position(wavelengths: list[float], target: float) -> int:
    """0-based position of the nearest wavelength, the first on a tie."""
    return min(range(len(wavelengths)), key=lambda i: (abs(wavelengths[i] - target), i))


def narrow_sql(name: str, wavelengths: list[float], at: Callable[[int], str], divide: Callable[[str, str], str]) -> str:
    """SQL of a narrow-band index; ``at`` names the value at a 0-based position."""
    _, needed, formula = NARROW[name]
    text = formula(divide)
    for w in sorted(needed, reverse=True):
        text = text.replace(f"w{w}", at(band_position(wavelengths, w)))
    return text


def red_edge_position(spectrum: Column, wavelengths: list[float]) -> Column:
    """Middle wavelength of the steepest step within 680 to 760 nm; NULL for fewer than three bands."""
    inside = [i for i, w in enumerate(wavelengths) if 680 <= w <= 760]
    if len(inside) < 3:
        return F.lit(None).cast("double")
    steps = F.array(*[spectrum[b] - spectrum[a] for a, b in zip(inside, inside[1:], strict=False)])
    middles = F.array(*[F.lit((wavelengths[a] + wavelengths[b]) / 2) for a, b in zip(inside, inside[1:], strict=False)])
    return F.element_at(middles, F.array_position(steps, F.array_max(steps)).cast("int"))


def with_narrow_indices(df: DataFrame, wavelengths: list[float], spectrum: str = "spectrum", groups: tuple[str, ...] | None = None) -> DataFrame:
    """Add the narrow-band indices whose wavelengths lie within the spectrum's range."""
    low, high = min(wavelengths), max(wavelengths)
    out = {
        k: F.expr(narrow_sql(k, wavelengths, lambda i: f"{spectrum}[{i}]", spark_divide))
        for k, (group, needed, _) in NARROW.items()
        if (groups is None or group in groups) and all(low <= w <= high for w in needed)
    }
    if groups is None or "chl" in groups:
        out["rep"] = red_edge_position(F.col(spectrum), wavelengths)
    return df.withColumns(out)
