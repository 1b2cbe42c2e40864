"""The configuration the catalogue's queries run with: a lexicon whose words occur in the test tables, and small settings."""

from __future__ import annotations

from ..config import EngineConfig, from_dict

LEXICON = {
    "level-1": ["idiot", "moron", "scum", "trash", "worthless"],
    "level-2": ["clown", "loser", "pathetic", "stupid", "disgusting"],
}
GAPS = {"level-1": (1, 2, 2)}  # level-2 has the default of 2 each
COMMANDS = ["/msg", "/tell", "/me", "/say", "/shout", "/other"]

SETTINGS = {
    "banned-words": LEXICON,
    "whitelist": ["stupidity", "trashing"],
    "fuzzy-match": {"enable": True, "levels": {"level-1": {"max-char-gap": {"chinese": 1, "english": 2, "others": 2}, "max-chatbox-gap": 3}}},
    "external-plugins": {
        "msg": {"args-number": "2", "extend-to-end": True, "commands": ["/msg", "/tell"]},
        "me": {"args-number": "", "commands": ["/me"]},
        "say": {"args-number": "1,3", "commands": ["/say"]},
        "off": {"enable": False, "commands": ["/other"]},
        "shout": {"args-number": "1", "extend-to-end": True, "commands": ["/shout"], "prefixes": ["!"]},
    },
    "punish-commands": {"levels": {"view": {3: ["mute %player%", "say %player% is muted"], 5: ["ban %player%"]}, "click": {2: ["warn %player%"]}}},
}
CONFIG: EngineConfig = from_dict(SETTINGS)

#: For conversations: common words, one level that follows words across messages.
CHAT: EngineConfig = from_dict(
    {"banned-words": {"level-1": ["thing"], "level-2": ["nothing"]}, "fuzzy-match": {"enable": False, "levels": {"level-1": {"max-chatbox-gap": 3}}}}
)

CATALOG = {
    "warnings.player-warning": "You used a banned word",
    "warnings.admin-warning": "%player% used %bannedword% in %context% (%level%)",
    "levels.level-1.player-warning": "You used a severe banned word",
    "levels.level-1.admin-warning": "SEVERE: %player% used %bannedword% in %context%",
}
CONTEXTS = {"src0": "Source zero", "src1": "", "src2": "Source two"}
FOLD_FROM, FOLD_TO = "àâäéèêëîïôöùûüçñ", "aaaeeeeiioouuucn"
