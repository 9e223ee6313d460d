"""Layouts, alphabets, thresholds, source names."""

from __future__ import annotations

from dataclasses import dataclass

# Keys of the English layout and the characters of the Hebrew layout on the same keys, in keyboard order.
EN_KEYS = "qwertyuiopasdfghjklzxcvbnm,./;'"
HE_KEYS = "/'קראטוןםפשדגכעיחלךזסבהנמצתץ.ף,"
LETTERS = "abcdefghijklmnopqrstuvwxyz"
PUNCTUATION = "`~!@#$%^&*()-_=+[{]}\\|;:'\",<.>/?"
HE_LETTERS = "".join(chr(c) for c in range(0x5D0, 0x5EB))

EN_ALLOWED = LETTERS + " " + PUNCTUATION
HE_ALLOWED = HE_LETTERS + " " + PUNCTUATION

#: From English keys to Hebrew characters: capital letters go where small ones go.
EN_FROM, EN_TO = EN_KEYS + LETTERS.upper(), HE_KEYS + "".join(HE_KEYS[EN_KEYS.index(c)] for c in LETTERS)
#: Back: letters come out as capitals.
HE_FROM, HE_TO = HE_KEYS, EN_KEYS.upper()
#: The strict map of lexicons: letters only, small, both ways one to one.
STRICT = [(h, e) for h, e in zip(HE_KEYS, EN_KEYS) if h in HE_LETTERS and e in LETTERS]
STRICT_FROM, STRICT_TO = "".join(h for h, _ in STRICT), "".join(e for _, e in STRICT)

#: White space as Unicode text knows it, as a class of regular expressions.
SPACE_CLASS = "\\s\\x0b\\x1c-\\x1f\\x85\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: The characters of that class.
SPACES = " \t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"

MAX_WORD = 12
LEXICON_WORDS, LEXICON_SHORT, LEXICON_LONG = 10_000, 2, 6
HISTORY = 50
IDLE_SECONDS = 15
BREAKS = ("click", "tab", "caps", "select_all", "suspend")
TOMBSTONES = ("[deleted]", "[removed]")

# Sources that are never judged, and sources that count as technical.
EXCLUDED_SOURCES = ("keepass.exe", "keepassxc.exe", "1password.exe", "bitwarden.exe", "credentialuibroker.exe", "consent.exe")
TECHNICAL_SOURCES = (
    "pycharm64.exe", "pycharm.exe", "idea64.exe", "idea.exe", "webstorm64.exe", "webstorm.exe", "clion64.exe", "clion.exe",
    "datagrip64.exe", "datagrip.exe", "rider64.exe", "rider.exe", "rubymine64.exe", "rubymine.exe", "goland64.exe", "goland.exe",
    "phpstorm64.exe", "phpstorm.exe", "studio64.exe", "studio.exe", "code.exe", "insiders.exe", "devenv.exe", "vim.exe",
    "gvim.exe", "nvim.exe", "nvim-qt.exe", "eclipse.exe", "netbeans64.exe", "netbeans.exe", "codeblocks.exe", "qtcreator.exe",
    "spyder.exe", "rstudio.exe", "matlab.exe",
)


@dataclass(frozen=True)
class Params:
    """Threshold: baseline + alpha * k ** p, with k the words completed since the last reset."""

    baseline: float = 4.0
    alpha: float = 0.5
    p: float = 2.0


DEFAULTS = Params()
# The parameter grid, 9 baselines, 9 alphas and 8 powers.
GRID_BASELINES = (2.0, 2.5, 3.0, 3.5, 4.0, 4.5, 5.0, 5.5, 6.0)
GRID_ALPHAS = (0.1, 0.3, 0.5, 0.7, 0.9, 1.1, 1.3, 1.5, 1.7)
GRID_POWERS = (1.0, 1.5, 2.0, 2.5, 3.0, 3.5, 4.0, 4.5)
