"""Fixed values that results depend on, in one place.

They are the published defaults of the analytics this package offers; every
operator takes them as keyword arguments, so none is hard-wired.
"""

# Moving averages, RSI, Bollinger bands
MA_SHORT = 50
MA_LONG = 200
RSI_PERIOD = 14
RSI_OVERSOLD = 30.0
BB_PERIOD = 20
BB_STD = 2.0
BB_WICK_LOOKBACK = 5

# Pivots and fractal dimension
PIVOT_PERIOD = 5
WEEKLY_PIVOT_PERIOD = 3
FD_WINDOW = 30
FD_TRENDING = 1.35
FD_CHOPPY = 1.65

# Chart indicators
VWAP_WINDOW = 20
ZSCORE_WINDOW = 50
KELTNER_EMA = 20
KELTNER_ATR = 10
KELTNER_MULT = 2.25
ATR_PERIOD = 14
ATR_STOP_MULT = 2.0
TRADING_DAYS = 252

# Futures symbol -> symbol with a liquid option chain
FUTURES_PROXY = {"ES=F": "SPY", "NQ=F": "QQQ", "YM=F": "DIA"}

# Weights of the seven evidence rows in the bias vote
SIGNAL_WEIGHTS = {
    "options_walls": 0.25,
    "gex_levels": 0.20,
    "iv_range": 0.20,
    "fractals": 0.15,
    "put_call_ratio": 0.10,
    "iv_skew": 0.05,
    "max_pain": 0.05,
}

# Range engine
PARKINSON_WINDOW = 20
VRP_LOOKBACK = 63
VRP_MIN = 0.70
VRP_MAX = 1.00
REGIME_SCALE = {"trending": 1.20, "transitional": 1.00, "choppy": 0.85}
TERM_SCALE = {"contango": 0.95, "backwardation": 1.10}
DEALER_BLEND = 0.30
SIGMAS = [("1sigma", 1.0, 68.3), ("1_5sigma", 1.5, 86.6), ("2sigma", 2.0, 95.4)]
MIN_IV = 0.05
STRIKE_BAND = 0.15
RISK_FREE = 0.045

# Weights of the five factors of the scan score
SCAN_WEIGHTS = {"rsi": 0.25, "zscore": 0.25, "volume": 0.15, "regime": 0.20, "atr": 0.15}
REGIME_POINTS = {"trending": 20.0, "transitional": 10.0, "choppy": 3.0}

# Volatility-index regimes, upper bounds and position size
VIX_BOUNDS = [("low_vol", 15.0), ("normal", 25.0), ("elevated", 35.0)]
VIX_SIZE = {"low_vol": 1.0, "normal": 1.0, "elevated": 0.5, "crisis": 0.0, "unknown": 0.5}

# Trade-order resampling
RESAMPLES = 1000

# Weight learning
RETUNE_MIN_DAYS = 60
RETUNE_WINDOW_DAYS = 90
RETUNE_MIN_ROWS = 20
RETUNE_MAX_CHANGE = 0.15
RETUNE_MIN_ACCURACY = 0.65
RETUNE_HOLDOUT = 0.20
RETUNE_MIN_WEIGHT = 0.02
RETUNE_MAX_WEIGHT = 0.40
WIDTH_MIX = {"iv_range": 0.4, "fractals": 0.3, "options_walls": 0.3}

# Default list of symbols to scan
WATCHLIST = [
    "AAPL", "MSFT", "GOOGL", "AMZN", "META", "NVDA", "TSLA", "AMD",
    "NFLX", "COIN", "PLTR", "SOFI", "RIVN", "NIO", "MSTR", "RBLX",
    "JPM", "BAC", "GS", "MS",
    "SPY", "QQQ", "ARKK",
    "INTC", "MU", "QCOM", "AVGO", "TSM",
    "DIS", "BA", "F", "GM",
]

# Parameter grids of the walk-forward sweep, in product order
PARAM_GRIDS = {
    "Fractal": {
        "fd_trending_threshold": [1.30, 1.35, 1.40, 1.45],
        "fd_choppy_threshold": [1.50, 1.55, 1.60],
        "sma_filter": [20, 50, 100],
        "lookback": [3, 5, 7],
    },
    "MA Crossover": {"short": [20, 50], "long": [100, 200]},
    "Ensemble": {"threshold": [2, 3, 4]},
}
