"""The license signature rules: names written by hand, times the forms in which licenses are cited.

Texts are matched as lower-case words joined by single spaces, so "Version 2.0"
reads "version 2 0".  A rule is (label, keyword, priority, score, regex); a text
is only searched for the rules whose keyword it contains at the start of a word.
A regex with several keywords is a rule for each; every text that it matches
holds one of them, so the keywords only save work.
"""

from __future__ import annotations

VER = r"(?: version| v)? ?"

#: label -> (keywords, regex of the name, SPDX spelling in words or "")
NAMES: dict[str, tuple[tuple[str, ...], str, str]] = {
    "apache-2.0": (("apache",), rf"apache(?: software)?(?: public)?(?: licen[cs]e)?{VER}2(?: 0)?", "apache 2 0"),
    "apache-1.1": (("apache",), rf"apache(?: software)? licen[cs]e{VER}1 1", "apache 1 1"),
    "apache-1.0": (("apache",), rf"apache(?: software)? licen[cs]e{VER}1 0", "apache 1 0"),
    "mit": (("mit",), r"(?:the )?mit(?: x11)? licen[cs]e", "mit"),
    "mit-0": (("mit",), r"mit no attribution(?: licen[cs]e)?", "mit 0"),
    "x11": (("x11",), r"x11 licen[cs]e", "x11"),
    "isc": (("isc",), r"isc(?: style)? licen[cs]e", "isc"),
    "bsd-2-clause": (("simplified bsd", "freebsd", "2 clause", "two clause"), r"(?:simplified bsd|freebsd|(?:bsd )?(?:2|two) clause(?: bsd)?) licen[cs]e", "bsd 2 clause"),
    "bsd-3-clause": (("new bsd", "modified bsd", "revised bsd", "3 clause", "three clause"), r"(?:new bsd|modified bsd|revised bsd|(?:bsd )?(?:3|three) clause(?: bsd)?) licen[cs]e", "bsd 3 clause"),
    "bsd-4-clause": (("original bsd", "4 clause", "four clause"), r"(?:original bsd|(?:bsd )?(?:4|four) clause(?: bsd)?) licen[cs]e", "bsd 4 clause"),
    "bsd": (("bsd",), r"bsd(?: style)? licen[cs]e", ""),
    "gpl-1.0": (("general public licen", "gpl"), rf"(?:gnu )?(?:general public licen[cs]e|gpl){VER}1(?: 0)?", "gpl 1 0"),
    "gpl-2.0": (("general public licen", "gpl"), rf"(?:gnu )?(?:general public licen[cs]e|gpl){VER}2(?: 0)?", "gpl 2 0"),
    "gpl-3.0": (("general public licen", "gpl"), rf"(?:gnu )?(?:general public licen[cs]e|gpl){VER}3(?: 0)?", "gpl 3 0"),
    "lgpl-2.0": (("library general public licen", "lgpl"), rf"(?:gnu )?(?:library general public licen[cs]e|lgpl){VER}2(?: 0)?", "lgpl 2 0"),
    "lgpl-2.1": (("lesser general public licen", "lgpl"), rf"(?:gnu )?(?:lesser general public licen[cs]e|lgpl){VER}2 1", "lgpl 2 1"),
    "lgpl-3.0": (("lesser general public licen", "lgpl"), rf"(?:gnu )?(?:lesser general public licen[cs]e|lgpl){VER}3(?: 0)?", "lgpl 3 0"),
    "agpl-3.0": (("affero general public licen", "agpl"), rf"(?:gnu )?(?:affero general public licen[cs]e|agpl){VER}3(?: 0)?", "agpl 3 0"),
    "gfdl-1.1": (("free documentation licen", "gfdl"), rf"(?:gnu )?(?:free documentation licen[cs]e|gfdl){VER}1 1", "gfdl 1 1"),
    "gfdl-1.2": (("free documentation licen", "gfdl"), rf"(?:gnu )?(?:free documentation licen[cs]e|gfdl){VER}1 2", "gfdl 1 2"),
    "gfdl-1.3": (("free documentation licen", "gfdl"), rf"(?:gnu )?(?:free documentation licen[cs]e|gfdl){VER}1 3", "gfdl 1 3"),
    "mpl-1.1": (("mozilla", "mpl"), rf"(?:mozilla public licen[cs]e|mpl){VER}1 1", "mpl 1 1"),
    "mpl-2.0": (("mozilla", "mpl"), rf"(?:mozilla public licen[cs]e|mpl){VER}2(?: 0)?", "mpl 2 0"),
    "epl-1.0": (("eclipse", "epl"), rf"(?:eclipse public licen[cs]e|epl){VER}1(?: 0)?", "epl 1 0"),
    "epl-2.0": (("eclipse", "epl"), rf"(?:eclipse public licen[cs]e|epl){VER}2(?: 0)?", "epl 2 0"),
    "eupl-1.2": (("european union public", "eupl"), rf"(?:european union public licen[cs]e|eupl){VER}1 2", "eupl 1 2"),
    "cddl-1.0": (("common development and distribution", "cddl"), rf"(?:common development and distribution licen[cs]e|cddl){VER}1 0", "cddl 1 0"),
    "cpl-1.0": (("common public licen",), rf"common public licen[cs]e{VER}1 0", "cpl 1 0"),
    "artistic-1.0": (("artistic",), rf"artistic licen[cs]e{VER}1(?: 0)?", "artistic 1 0"),
    "artistic-2.0": (("artistic",), rf"artistic licen[cs]e{VER}2(?: 0)?", "artistic 2 0"),
    "bsl-1.0": (("boost",), rf"boost software licen[cs]e(?:{VER}1(?: 0)?)?", "bsl 1 0"),
    "zlib": (("zlib",), r"zlib(?: libpng)? licen[cs]e", "zlib"),
    "openssl": (("openssl",), r"openssl licen[cs]e", "openssl"),
    "php-3.01": (("php",), rf"php licen[cs]e{VER}3 01", "php 3 01"),
    "psf-2.0": (("python software foundation",), rf"python software foundation licen[cs]e(?:{VER}2)?", "psf 2 0"),
    "postgresql": (("postgresql",), r"postgresql licen[cs]e", "postgresql"),
    "unlicense": (("unlicense",), r"(?:the )?unlicense", "unlicense"),
    "wtfpl": (("wtfpl",), r"wtfpl(?: licen[cs]e)?", "wtfpl"),
    "ms-pl": (("microsoft public", "ms pl"), r"(?:microsoft public licen[cs]e|ms pl)", "ms pl"),
    "ms-rl": (("microsoft reciprocal", "ms rl"), r"(?:microsoft reciprocal licen[cs]e|ms rl)", "ms rl"),
    "ofl-1.1": (("open font licen",), rf"(?:sil )?open font licen[cs]e(?:{VER}1 1)?", "ofl 1 1"),
    "odbl-1.0": (("open database licen", "odbl"), rf"(?:open database licen[cs]e|odbl)(?:{VER}1(?: 0)?)?", "odbl 1 0"),
    "cc0-1.0": (("cc0", "creative commons"), r"(?:cc0(?: 1 0)?|creative commons zero)(?: universal)?", "cc0 1 0"),
    "cc-by-4.0": (("creative commons", "cc by"), rf"(?:creative commons attribution|cc by)(?: international)?{VER}4(?: 0)?", "cc by 4 0"),
    "cc-by-3.0": (("creative commons", "cc by"), rf"(?:creative commons attribution|cc by)(?: unported)?{VER}3(?: 0)?", "cc by 3 0"),
    "cc-by-2.0": (("creative commons", "cc by"), rf"(?:creative commons attribution|cc by){VER}2(?: 0)?", "cc by 2 0"),
    "cc-by-sa-4.0": (("creative commons", "cc by"), rf"(?:creative commons attribution share ?alike|cc by sa)(?: international)?{VER}4(?: 0)?", "cc by sa 4 0"),
    "cc-by-sa-3.0": (("creative commons", "cc by"), rf"(?:creative commons attribution share ?alike|cc by sa)(?: unported)?{VER}3(?: 0)?", "cc by sa 3 0"),
    "cc-by-nd-4.0": (("creative commons", "cc by"), rf"(?:creative commons attribution no ?deriv(?:ative)?s?(?: works)?|cc by nd){VER}4(?: 0)?", "cc by nd 4 0"),
    "cc-by-nc-4.0": (("creative commons", "cc by"), rf"(?:creative commons attribution non ?commercial|cc by nc){VER}4(?: 0)?", "cc by nc 4 0"),
    "cc-by-nc-sa-4.0": (("creative commons", "cc by"), rf"(?:creative commons attribution non ?commercial share ?alike|cc by nc sa){VER}4(?: 0)?", "cc by nc sa 4 0"),
    "cc-by-nc-nd-4.0": (("creative commons", "cc by"), rf"(?:creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?|cc by nc nd){VER}4(?: 0)?", "cc by nc nd 4 0"),
}

#: (form regex around the name, priority, score): a lower priority number wins.
FORMS = [
    (r"(?:dual |multi )?licen[cs]ed(?: to you)? under (?:the )?(?:terms (?:and conditions )?of )?(?:the )?{name}", 1, 0.95),
    (r"(?:released|distributed|published|available|provided) under (?:the )?(?:terms (?:and conditions )?of )?(?:the )?{name}", 1, 0.9),
    (r"(?:subject to|governed by|covered by|in compliance with) (?:the )?(?:terms (?:and conditions )?of )?(?:the )?{name}", 1, 0.9),
    (r"{name} or (?:at your option )?(?:any )?later(?: version)?", 2, 0.85),
    (r"{name}", 2, 0.8),
]

#: Rules without a name of their own: (label, keyword, priority, score, regex).
GENERAL = [
    ("mit", "permission is hereby granted", 1, 0.95, r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("isc", "permission to use copy modify", 1, 0.9, r"permission to use copy modify and or distribute this software for any purpose"),
    ("bsd", "redistribution and use", 1, 0.9, r"redistribution and use in source and binary forms(?: with or without modification)?"),
    ("zlib", "warranty", 1, 0.9, r"this software is provided as is without any express or implied warranty"),
    ("apache-2.0", "licenses license 2", 1, 0.9, r"www apache org licenses license 2 0"),
    ("gpl", "gnu", 2, 0.8, r"gnu general public licen[cs]e"),
    ("gpl", "gpl", 3, 0.6, r"gnu gpl|gpl licen[cs]ed?"),
    ("lgpl", "gnu", 2, 0.8, r"gnu (?:lesser|library) general public licen[cs]e"),
    ("agpl", "affero", 2, 0.8, r"(?:gnu )?affero general public licen[cs]e"),
    ("cc-by", "creativecommons", 1, 0.9, r"creativecommons org licenses by(?: \d 0)?"),
    ("cc-by-sa", "creativecommons", 1, 0.9, r"creativecommons org licenses by sa(?: \d 0)?"),
    ("cc-by-nc", "creativecommons", 1, 0.9, r"creativecommons org licenses by nc(?: \d 0)?"),
    ("cc0-1.0", "creativecommons", 1, 0.9, r"creativecommons org publicdomain zero 1 0"),
    ("creative-commons", "creative commons", 3, 0.6, r"creative commons(?: attribution)?(?: licen[cs]e)?"),
    ("public-domain", "public domain", 2, 0.7, r"(?:in|into|to) the public domain|public domain dedication"),
    ("copyright", "copyright", 3, 0.5, r"copyright(?: c)? (?:19|20)\d\d(?: (?:19|20)?\d\d)*"),
    ("reserved", "all rights reserved", 2, 0.7, r"(?:copyright(?: c)? (?:19|20)\d\d [^ ]+(?: [^ ]+){0,5} )?all rights reserved"),
    ("proprietary", "proprietary", 2, 0.7, r"proprietary and confidential|confidential and proprietary|proprietary licen[cs]e"),
    ("no-redistribution", "redistribution", 2, 0.7, r"(?:unauthori[sz]ed )?redistribution (?:is )?(?:strictly )?prohibited"),
    *[("no-commercial-use", keyword, 2, 0.7, r"(?:for )?non ?commercial use only|commercial use (?:is )?(?:strictly )?prohibited")
      for keyword in ("commercial use", "noncommercial use")],
    *[("license-notice", keyword, 3, 0.5, r"licen[cs]ed under(?: the)?(?: [^ ]+){1,3} licen[cs]e")
      for keyword in ("licensed under", "licenced under")],
]


def rules() -> list[tuple[int, str, str, int, float, str]]:
    """(rule id, label, keyword, priority, score, regex), whole words only."""
    out = []
    for label, (keywords, name, spdx) in NAMES.items():
        for keyword in keywords:
            for form, priority, score in FORMS:
                out.append((label, keyword, priority, score, form.replace("{name}", f"(?:{name})")))
        if spdx:
            out.append((label, "spdx license identifier", 0, 1.0, rf"spdx license identifier {spdx}(?: (?:only|or later))?"))
    out += GENERAL
    return [(i, *r[:4], rf"(?<![^ ])(?:{r[4]})(?![^ ])") for i, r in enumerate(out)]
