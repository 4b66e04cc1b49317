"""Word lists of the text functions."""

# Words that are good, words that are bad, and words that strengthen the next one.
POSITIVE = [
    "good", "great", "awesome", "excellent", "amazing", "love", "best", "perfect", "nice", "wonderful", "fantastic", "brilliant", "superb", "outstanding", "happy",
    "beautiful", "helpful", "thanks", "thank", "appreciate", "recommend", "interesting", "useful", "cool", "fun", "enjoy", "like", "loved", "impressive", "incredible",
]
NEGATIVE = [
    "bad", "terrible", "awful", "horrible", "hate", "worst", "poor", "disappointing", "useless", "waste", "annoying", "boring", "ugly", "stupid", "dumb", "fail",
    "wrong", "broken", "sad", "angry", "frustrated", "scam", "fake", "trash", "pathetic", "ridiculous", "disgusting", "overpriced", "avoid", "never",
]
INTENSIFIERS = ["very", "really", "extremely", "absolutely", "totally", "completely"]

# Words in capitals that are no tickers, and tickers that are words too, which count only with a cash mark.
STOP = [
    "A", "I", "AN", "AS", "AT", "BE", "BY", "DO", "GO", "IF", "IN", "IS", "IT", "ME", "MY", "NO", "OF", "ON", "OR", "SO", "TO", "UP", "US", "WE", "AM", "PM",
    "DD", "FD", "FDS", "TA", "PT", "TP", "SL", "IV", "PE", "EPS", "ATH", "ATL", "CEO", "CFO", "COO", "CTO", "IPO", "ETF", "ER", "AH", "EOD", "EOW", "YTD",
    "USA", "UK", "EU", "GDP", "FED", "SEC", "IRS", "FDA", "FBI", "CIA", "AI", "EV", "PC", "TV", "OK", "LOL", "WTF", "WSB", "YOLO", "FOMO", "FUD", "HODL",
    "IMO", "IMHO", "TLDR", "EDIT", "NSFW", "OP", "PSA", "FAQ", "AMA", "OTM", "ITM", "ATM", "DTE", "OI", "VWAP", "RSI", "MACD", "SMA", "EMA", "MA",
    "ROI", "PNL", "PL", "QE", "QT", "CPI", "PPI", "FOMC", "RH", "TD", "API", "URL", "USD", "EUR", "GBP", "JPY", "CAD", "AUD", "ID", "OG", "GG", "EZ",
    "ALL", "ANY", "ARE", "BIG", "BUY", "CAN", "FOR", "GET", "GOT", "HAS", "HE", "HER", "HIS", "HOW", "ITS", "LET", "MAN", "NEW", "NOT", "NOW", "OUT", "OWN",
    "PUT", "SEE", "SHE", "THE", "TOO", "TRY", "WAS", "WAY", "WHO", "WHY", "YES", "RED", "WIN", "LOW", "TOP", "BAD", "FUN", "HOT", "JOB", "KEY", "RUN", "WAR",
    "EOY", "MOM", "DAD", "BRO", "GUY", "LMAO", "RIP", "DCA", "SP", "SPX", "DJI",
]
AMBIGUOUS = [
    "LIVE", "GOOD", "TIME", "SOAR", "BOOM", "PR", "SI", "OPEN", "REAL", "CASH", "PLAY", "WELL", "BEST", "LOVE", "HOPE", "FREE", "GAIN", "SAVE", "PLUS", "NICE", "SAFE", "FAST",
    "RICH", "GROW", "RIDE", "EDGE", "WORK", "MOVE", "CARE", "FLOW", "HUGE", "PEAK", "TRUE", "WISH", "EYES", "HEAR", "TELL", "TURN", "STEP", "LIFE", "MAIN", "BOND", "FUND", "DATA",
]
