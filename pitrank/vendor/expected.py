"""Tables and columns the vendor transforms read, for comparison with what has been landed."""
from __future__ import annotations

from .accounting import ANNUAL_COLUMNS, QUARTERLY_COLUMNS, STANDARD_FORMAT
from .equity import CIZ_COMMON_STOCK

# Vendor table names and their columns.
EXPECTED_TABLES = {
    "crsp.msf": ["permno", "date", "ret", "prc", "shrout"],
    "crsp.msenames": ["permno", "namedt", "nameendt", "shrcd", "exchcd", "siccd"],
    "crsp.msedelist": ["permno", "dlstdt", "dlret", "dlstcd"],
    "crsp.msf_v2": ["permno", "mthcaldt", "mthret", "mthprc", "shrout", "siccd", *CIZ_COMMON_STOCK],
    "crsp.stkdelists": ["permno", "delistingdt", "delret", "delreasontype"],
    "crsp.msi": ["date", "vwretd", "ewretd"],
    "crsp.msp500": ["caldt", "vwretd"],
    "comp.fundq": [*QUARTERLY_COLUMNS, *STANDARD_FORMAT, "cshoq"],
    "comp.funda": [*ANNUAL_COLUMNS, *STANDARD_FORMAT, "csho"],
    "crsp.ccmxpf_lnkhist": ["gvkey", "lpermno", "linktype", "linkprim", "linkdt", "linkenddt"],
    "ff.factors_monthly": ["date", "rf"],
}
