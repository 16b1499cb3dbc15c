"""Formulas of the indices in DuckDB's SQL, for the checks alone: nothing that is checked is built from them."""

from __future__ import annotations


def q(a: str, b: str) -> str:
    """A quotient that is NULL where the denominator is zero."""
    return f"(({a}) / nullif({b}, 0))"


# The published formulas, by tier; zero denominators and negative roots give NULL.
EXACT: dict[int, dict[str, str]] = {
    1: {
        "ndvi": q("n - r", "n + r"), "ndre": q("n - e", "n + e"), "gndvi": q("n - g", "n + g"), "cire": q("n", "e") + " - 1", "cigreen": q("n", "g") + " - 1",
        "osavi": "1.16::double * " + q("n - r", "n + r + 0.16::double"), "evi": "2.5::double * " + q("n - r", "n + 6 * r - 7.5::double * b + 1"),
        "evi2": "2.5::double * " + q("n - r", "n + 2.4::double * r + 1"), "ccci": q(q("n - e", "n + e"), q("n - r", "n + r")),
    },
    2: {
        "mtci": q("n - e", "e - r"), "datt": q("n - e", "n - r"), "savi": "1.5::double * " + q("n - r", "n + r + 0.5::double"), "wdrvi": q("0.2::double * n - r", "0.2::double * n + r"),
        "sipi": q("n - b", "n - r"), "psri": q("r - g", "e"), "ari": q("1", "g") + " - " + q("1", "e"),
        "tcari": f"3 * ((e - r) - 0.2::double * (e - g) * {q('e', 'r')})", "mcari": f"((e - r) - 0.2::double * (e - g)) * {q('e', 'r')}",
        "tcari_osavi": q(f"3 * ((e - r) - 0.2::double * (e - g) * {q('e', 'r')})", "1.16::double * " + q("n - r", "n + r + 0.16::double")),
        "mcari_osavi": q(f"((e - r) - 0.2::double * (e - g)) * {q('e', 'r')}", "1.16::double * " + q("n - r", "n + r + 0.16::double")),
    },
    3: {
        "sr": q("n", "r"), "dvi": "n - r", "rdvi": "case when n + r > 0 then (n - r) / sqrt(n + r) end", "rendvi": q("e - r", "e + r"), "lci": q("n - e", "n + r"), "cvi": q("n * r", "g * g"),
        "npci": q("r - b", "r + b"), "ngrdi": q("g - r", "g + r"), "tgi": "-0.5::double * (218 * (r - g) - 108 * (r - b))", "arvi": q("n - (2 * r - b)", "n + (2 * r - b)"), "bndvi": q("n - b", "n + b"),
        "grndvi": q("n - (g + r)", "n + g + r"), "msr": f"case when {q('n', 'r')} + 1 > 0 then ({q('n', 'r')} - 1) / sqrt({q('n', 'r')} + 1) end", "nli": q("n * n - r", "n * n + r"),
        "nirv": "n * " + q("n - r", "n + r"), "msavi2": "case when (2 * n + 1) * (2 * n + 1) - 8 * (n - r) >= 0 then (2 * n + 1 - sqrt((2 * n + 1) * (2 * n + 1) - 8 * (n - r))) / 2 end",
        "vari": q("g - r", "g + r - b"), "gli": q("2 * g - r - b", "2 * g + r + b"), "srre": q("n", "e"), "rtvicore": "100 * (n - e) - 10 * (n - g)", "cri700": q("1", "b") + " - " + q("1", "e"),
        "bgi": q("b", "g"), "rgri": q("r", "g"), "srpi": q("b", "r"),
    },
}

# The same family with 1e-8 in every denominator.
PADDED: dict[str, str] = {
    "ndvi": "(n - r) / (n + r + 1e-8)", "gndvi": "(n - g) / (n + g + 1e-8)", "ndre": "(n - e) / (n + e + 1e-8)", "bndvi": "(n - b) / (n + b + 1e-8)", "savi": "1.5::double * (n - r) / (n + r + 0.5::double + 1e-8)",
    "evi": "2.5::double * (n - r) / (n + 6 * r - 7.5::double * b + 1 + 1e-8)", "evi2": "2.5::double * (n - r) / (n + 2.4::double * r + 1 + 1e-8)", "osavi": "1.16::double * (n - r) / (n + r + 0.16::double + 1e-8)",
    "msr": "(n / (r + 1e-8) - 1) / (sqrt(n / (r + 1e-8) + 1e-8) + 1e-8)", "cigreen": "n / (g + 1e-8) - 1", "cire": "n / (e + 1e-8) - 1", "ccci": "((n - e) / (n + e + 1e-8)) / ((n - r) / (n + r + 1e-8) + 1e-8)",
    "psri": "(r - b) / (e + 1e-8)", "mcari": "((e - r) - 0.2::double * (e - g)) * (e / (r + 1e-8))", "tcari": "3 * ((e - r) - 0.2::double * (e - g) * (e / (r + 1e-8)))",
    "mcari_osavi": "((e - r) - 0.2::double * (e - g)) * (e / (r + 1e-8)) / (1.16::double * (n - r) / (n + r + 0.16::double + 1e-8) + 1e-8)", "rdvi": "(n - r) / sqrt(n + r + 1e-8)",
    "wdrvi": "(0.1::double * n - r) / (0.1::double * n + r + 1e-8)", "grndvi": "(n - (g + r)) / (n + (g + r) + 1e-8)", "tgi": "g - 0.39::double * r - 0.61::double * b", "gli": "(2 * g - r - b) / (2 * g + r + b + 1e-8)",
    "vari": "(g - r) / (g + r - b + 1e-8)", "ngrdi": "(g - r) / (g + r + 1e-8)", "sr": "n / (r + 1e-8)", "srre": "n / (e + 1e-8)", "dvi": "n - r", "ndvi_re": "(e - r) / (e + r + 1e-8)", "lswi": "(n - e) / (n + e + 1e-8)",
    "mtci": "(n - e) / (e - r + 1e-8)", "ireci": "(n - r) / (e / (g + 1e-8) + 1e-8)", "nli": "(n * n - r) / (n * n + r + 1e-8)", "msrre": "(n / (e + 1e-8) - 1) / (sqrt(n / (e + 1e-8) + 1e-8) + 1e-8)",
    "rtvicore": "100 * (n - e) - 10 * (n - g)", "cri700": "1 / (g + 1e-8 + 1e-8) - 1 / (e + 1e-8 + 1e-8)", "ari": "1 / (g + 1e-8 + 1e-8) - 1 / (e + 1e-8 + 1e-8)", "srpi": "b / (r + 1e-8)", "npci": "(r - b) / (r + b + 1e-8)",
    "bgi": "b / (g + 1e-8)", "gi": "g / (r + 1e-8)", "datt": "((n - e) / (n + e + 1e-8)) / ((n - r) / (n + r + 1e-8) + 1e-8)", "rgri": "r / (g + 1e-8)", "ndvi_blue": "(n - b) / (n + b + 1e-8)",
    "nirv": "(n - r) / (n + r + 1e-8) * n",
}

# The twelve indices of image channels.
CHANNELS: dict[str, str] = {k: (EXACT[1] | EXACT[2] | EXACT[3])[k] for k in ("ndre", "ccci", "msavi2", "mcari", "tcari_osavi", "srpi", "ari", "mcari_osavi", "npci", "datt", "cri700", "cire")}

# The narrow-band formulas; w<nm> is the value at the nearest band.
NARROW: dict[str, str] = {
    "mnd705": q("w750 - w705", "w750 + w705 - 2 * w445"), "vog1": q("w740", "w720"), "vog2": q("w734 - w747", "w715 + w726"), "chl_re": q("w750", "w710") + " - 1", "dd": "(w749 - w720) - (w701 - w672)",
    "mcari_narrow": f"((w700 - w670) - 0.2::double * (w700 - w550)) * {q('w700', 'w670')}", "tcari_narrow": f"3 * ((w700 - w670) - 0.2::double * (w700 - w550) * {q('w700', 'w670')})",
    "osavi_narrow": "1.16::double * " + q("w800 - w670", "w800 + w670 + 0.16::double"),
    "tcari_osavi_narrow": q(f"3 * ((w700 - w670) - 0.2::double * (w700 - w550) * {q('w700', 'w670')})", "1.16::double * " + q("w800 - w670", "w800 + w670 + 0.16::double")),
    "zm": q("w750", "w710"), "gi_narrow": q("w554", "w677"), "pri": q("w531 - w570", "w531 + w570"), "sipi_narrow": q("w800 - w445", "w800 - w680"), "cri550": q("1", "w510") + " - " + q("1", "w550"),
    "ari_narrow": q("1", "w550") + " - " + q("1", "w700"), "psri_narrow": q("w678 - w500", "w750"), "wbi": q("w900", "w970"), "ndwi_hyper": q("w860 - w1020", "w860 + w1020"), "msi": q("w819", "w1020"),
    "r_fe": q("w700 - w670", "w750 - w550"), "r_mn": q("w741 - w720", "w741 + w720"), "r_zn": q("w903 - w860", "w903 + w860"), "r_ca": q("w798", "w750"),
}
