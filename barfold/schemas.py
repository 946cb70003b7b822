"""Column contracts shared by the sources and the operators."""

from pyspark.sql import types as T

_STRINGS = ("isin", "symbol", "series")
_DOUBLES = ("open", "high", "low", "close", "prev_close", "last", "volume", "turnover")

BARS = T.StructType(
    [T.StructField("date", T.DateType())]
    + [T.StructField(c, T.StringType()) for c in _STRINGS]
    + [T.StructField(c, T.DoubleType()) for c in _DOUBLES]
    + [T.StructField("n_trades", T.LongType())]
)

CURATED = T.StructType(
    list(BARS.fields)
    + [T.StructField("isin_is_symbol_fallback", T.BooleanType()),
       T.StructField("adj_factor", T.DoubleType())]
    + [T.StructField(c, T.DoubleType()) for c in ("open_adj", "high_adj", "low_adj", "close_adj")]
)

RAW_ACTIONS = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("isin", "symbol", "series", "exDate", "subject")]
)

FACTORS = T.StructType([
    T.StructField("isin", T.StringType()),
    T.StructField("ex_date", T.DateType()),
    T.StructField("cum_factor", T.DoubleType()),
])

MEMBERSHIP_COLUMNS = (
    "as_of_date", "index", "symbol", "isin", "company_name", "industry", "series",
)

# File headers of the exchange's two day-file layouts.
OLD_LAYOUT = {
    "SYMBOL": "symbol",
    "SERIES": "series",
    "OPEN": "open",
    "HIGH": "high",
    "LOW": "low",
    "CLOSE": "close",
    "LAST": "last",
    "PREVCLOSE": "prev_close",
    "TOTTRDQTY": "volume",
    "TOTTRDVAL": "turnover",
    "TOTALTRADES": "n_trades",
    "ISIN": "isin",
}
NEW_LAYOUT = {
    "TckrSymb": "symbol",
    "SctySrs": "series",
    "OpnPric": "open",
    "HghPric": "high",
    "LwPric": "low",
    "ClsPric": "close",
    "LastPric": "last",
    "PrvsClsgPric": "prev_close",
    "TtlTradgVol": "volume",
    "TtlTrfVal": "turnover",
    "TtlNbOfTxsExctd": "n_trades",
    "ISIN": "isin",
    "FinInstrmTp": "instrument_type",
}
NEW_LAYOUT_MARKER = "TckrSymb"
EQUITY_INSTRUMENT = "STK"

# The model inputs, in tensor order, and the label.
FEATURE_COLUMNS = (
    "ret_1", "ret_o", "ret_h", "ret_l",
    "ret_1_volscaled",
    "vol_z",
    "dow_sin", "dow_cos", "dom_sin", "dom_cos", "month_sin", "month_cos",
)
TARGET_COLUMN = "fwd_ret_1"

# Forecast quantile levels.
QUANTILES = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)
