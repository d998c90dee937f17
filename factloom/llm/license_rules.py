"""Signature rules of the licence scan: names, identifiers and addresses of public licences, in order of priority.

A licence has a hand-written regex for its name; forms put it in a tag, a grant, a title or an address. Passages of the licences' own
texts tell one that is pasted without its name. A rule's regex is tried only on texts that hold its keywords.
"""

from __future__ import annotations

import re
from typing import NamedTuple


class Rule(NamedTuple):
    label: str
    priority: int  # 0 is the strongest
    keyword: str  # lower case; every match holds it, whatever its case
    regex: str
    base: bool = False
    also: str = ""  # another keyword of every match


#: Characters of words once A-Z are lower case, and the others.
WORD, OTHER = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
BASE_PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: (label, keyword of the name, regex of the name, regex of the address or none)
LICENCES = (
    ("mit", "mit", r"mit(?: |-)?licen[sc]e", r"opensource\.org/licenses?/mit"),
    ("mit-0", "attribution", r"mit no attribution", r"opensource\.org/licenses?/mit-0"),
    ("x11", "x11", r"x11 licen[sc]e", None),
    ("isc", "isc", r"isc licen[sc]e", r"opensource\.org/licenses?/isc"),
    ("apache-1.1", "apache", r"apache (?:software )?licen[sc]e,? (?:version |v)?1\.1", r"apache\.org/licenses/license-1\.1"),
    ("apache-2.0", "apache", r"apache (?:software )?licen[sc]e,? (?:version |v)?2(?:\.0)?", r"apache\.org/licenses/license-2\.0"),
    ("gpl-1.0", "general public", r"gnu general public licen[sc]e,? (?:version |v)1(?:\.0)?", r"gnu\.org/licenses/(?:old-licenses/)?gpl-1\.0"),
    ("gpl-2.0", "general public", r"gnu general public licen[sc]e,? (?:version |v)2(?:\.0)?", r"gnu\.org/licenses/(?:old-licenses/)?gpl-2\.0"),
    ("gpl-3.0", "general public", r"gnu general public licen[sc]e,? (?:version |v)3(?:\.0)?", r"gnu\.org/licenses/gpl-3\.0"),
    ("gpl-any", "general public", r"gnu general public licen[sc]e", r"gnu\.org/licenses/gpl\.html"),
    ("lgpl-2.0", "general public", r"gnu library general public licen[sc]e", r"gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.0"),
    ("lgpl-2.1", "general public", r"gnu lesser general public licen[sc]e,? (?:version |v)2\.1", r"gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.1"),
    ("lgpl-3.0", "general public", r"gnu lesser general public licen[sc]e,? (?:version |v)3(?:\.0)?", r"gnu\.org/licenses/lgpl-3\.0"),
    ("agpl-3.0", "affero", r"(?:gnu )?affero general public licen[sc]e,? (?:version |v)3(?:\.0)?", r"gnu\.org/licenses/agpl-3\.0"),
    ("gfdl-1.2", "documentation", r"gnu free documentation licen[sc]e,? (?:version |v)1\.2", r"gnu\.org/licenses/fdl-1\.2"),
    ("gfdl-1.3", "documentation", r"gnu free documentation licen[sc]e,? (?:version |v)1\.3", r"gnu\.org/licenses/fdl-1\.3"),
    ("bsd-2-clause", "bsd", r"(?:simplified bsd licen[sc]e|bsd 2-clause(?: licen[sc]e)?|2-clause bsd)", r"opensource\.org/licenses?/bsd-2-clause"),
    ("bsd-3-clause", "bsd", r"(?:(?:new|modified|revised) bsd licen[sc]e|bsd 3-clause(?: licen[sc]e)?|3-clause bsd)", r"opensource\.org/licenses?/bsd-3-clause"),
    ("bsd-4-clause", "bsd", r"(?:original bsd licen[sc]e|bsd 4-clause(?: licen[sc]e)?|4-clause bsd)", None),
    ("0bsd", "bsd", r"(?:zero-clause bsd|0bsd|bsd zero clause)(?: licen[sc]e)?", r"opensource\.org/licenses?/0bsd"),
    ("bsd-any", "bsd", r"bsd(?:-style)? licen[sc]e", None),
    ("mpl-1.1", "mozilla", r"mozilla public licen[sc]e,? (?:version |v)?1\.1", r"mozilla\.org/mpl/1\.1"),
    ("mpl-2.0", "mozilla", r"mozilla public licen[sc]e,? (?:version |v)?2(?:\.0)?", r"mozilla\.org/mpl/2\.0"),
    ("epl-1.0", "eclipse", r"eclipse public licen[sc]e(?:,| -)? (?:version |v)?1(?:\.0)?", r"eclipse\.org/legal/epl-v10"),
    ("epl-2.0", "eclipse", r"eclipse public licen[sc]e(?:,| -)? (?:version |v)?2(?:\.0)?", r"eclipse\.org/legal/epl-(?:v20|2\.0)"),
    ("cddl-1.0", "common development", r"common development and distribution licen[sc]e", r"opensource\.org/licenses?/cddl"),
    ("cpl-1.0", "common public", r"common public licen[sc]e,? (?:version |v)?1(?:\.0)?", r"opensource\.org/licenses?/cpl1\.0"),
    ("cpal-1.0", "common public", r"common public attribution licen[sc]e", r"opensource\.org/licenses?/cpal_1\.0"),
    ("eupl-1.1", "european union", r"european union public licen[sc]e,? (?:version |v)?1\.1", None),
    ("eupl-1.2", "european union", r"european union public licen[sc]e,? (?:version |v)?1\.2", r"joinup\.ec\.europa\.eu/[a-z/]*eupl"),
    ("artistic-1.0", "artistic", r"artistic licen[sc]e,? (?:version |v)?1(?:\.0)?", r"opensource\.org/licenses?/artistic-1\.0"),
    ("artistic-2.0", "artistic", r"artistic licen[sc]e,? (?:version |v)?2(?:\.0)?", r"opensource\.org/licenses?/artistic-2\.0"),
    ("bsl-1.0", "boost", r"boost software licen[sc]e", r"boost\.org/license_1_0"),
    ("busl-1.1", "business source", r"business source licen[sc]e", r"mariadb\.com/bsl11"),
    ("sspl-1.0", "server side", r"server side public licen[sc]e", r"mongodb\.com/licensing/server-side-public-license"),
    ("elastic-2.0", "elastic", r"elastic licen[sc]e,? (?:version |v)?2(?:\.0)?", r"elastic\.co/licensing/elastic-license"),
    ("ms-pl", "microsoft", r"microsoft public licen[sc]e", r"opensource\.org/licenses?/ms-pl"),
    ("ms-rl", "microsoft", r"microsoft reciprocal licen[sc]e", r"opensource\.org/licenses?/ms-rl"),
    ("zlib", "zlib", r"zlib(?:/libpng)? licen[sc]e", r"opensource\.org/licenses?/zlib"),
    ("libpng", "libpng", r"libpng licen[sc]e", r"libpng\.org/pub/png/src/libpng-license"),
    ("openssl", "openssl", r"openssl licen[sc]e", r"openssl\.org/source/license"),
    ("php-3.0", "php", r"php licen[sc]e,? (?:version |v)?3(?:\.0)?", r"php\.net/license/3_0"),
    ("php-3.01", "php", r"php licen[sc]e,? (?:version |v)?3\.01", r"php\.net/license/3_01"),
    ("python-2.0", "python", r"python software foundation licen[sc]e", r"docs\.python\.org/[0-9.]+/license"),
    ("ruby", "ruby", r"ruby licen[sc]e", r"ruby-lang\.org/en/about/license"),
    ("postgresql", "postgresql", r"postgresql licen[sc]e", r"opensource\.org/licenses?/postgresql"),
    ("ncsa", "illinois", r"university of illinois/ncsa open source licen[sc]e", r"opensource\.org/licenses?/ncsa"),
    ("ofl-1.1", "open font", r"(?:sil )?open font licen[sc]e", r"scripts\.sil\.org/ofl"),
    ("odbl-1.0", "open database", r"open database licen[sc]e", r"opendatacommons\.org/licenses/odbl"),
    ("odc-by-1.0", "data commons", r"open data commons attribution licen[sc]e", r"opendatacommons\.org/licenses/by"),
    ("pddl-1.0", "public domain dedication", r"public domain dedication and licen[sc]e", r"opendatacommons\.org/licenses/pddl"),
    ("unlicense", "unlicense", r"the unlicense", r"unlicense\.org"),
    ("wtfpl", "wtfpl", r"wtfpl(?: licen[sc]e)?", r"wtfpl\.net"),
    ("cecill-2.1", "cecill", r"cecill(?: free software)? licen[sc]e", r"cecill\.info/licences"),
    ("vim", "vim", r"vim licen[sc]e", None),
    ("w3c", "w3c", r"w3c software (?:notice and )?licen[sc]e", r"w3\.org/consortium/legal/copyright-software"),
    ("upl-1.0", "universal permissive", r"universal permissive licen[sc]e", r"opensource\.org/licenses?/upl"),
    ("osl-3.0", "open software", r"open software licen[sc]e,? (?:version |v)?3(?:\.0)?", r"opensource\.org/licenses?/osl-3\.0"),
    ("gpl-1.0", "gpl", r"(?:gnu )?gpl[ -]?(?:version |v)?1(?:\.0)?\+?", None),
    ("gpl-2.0", "gpl", r"(?:gnu )?gpl(?:,? (?:version |v)?|-|[- ]?v)2(?:\.0)?(?:\+|(?:,| or)? (?:or )?(?:any )?(?:later|newer)(?: version)?)?", None),
    ("gpl-3.0", "gpl", r"(?:gnu )?gpl(?:,? (?:version |v)?|-|[- ]?v)3(?:\.0)?(?:\+|(?:,| or)? (?:or )?(?:any )?(?:later|newer)(?: version)?)?", None),
    ("gpl-any", "gpl", r"gnu gpl", None),
    ("lgpl-2.0", "gpl", r"(?:gnu )?lgpl(?:,? (?:version |v)?|-|[- ]?v)2(?:\.0)?\+?", None),
    ("lgpl-2.1", "gpl", r"(?:gnu )?lgpl(?:,? (?:version |v)?|-|[- ]?v)2\.1(?:\+|(?:,| or)? (?:or )?(?:any )?(?:later|newer)(?: version)?)?", None),
    ("lgpl-3.0", "gpl", r"(?:gnu )?lgpl(?:,? (?:version |v)?|-|[- ]?v)3(?:\.0)?(?:\+|(?:,| or)? (?:or )?(?:any )?(?:later|newer)(?: version)?)?", None),
    ("agpl-3.0", "gpl", r"(?:gnu )?agpl(?:,? (?:version |v)?|-|[- ]?v)3(?:\.0)?(?:\+|(?:,| or)? (?:or )?(?:any )?(?:later|newer)(?: version)?)?", None),
    ("mpl-1.1", "~short", r"mpl(?:,? (?:version |v)?|-|v)1\.1", None),
    ("mpl-2.0", "~short", r"mpl(?:,? (?:version |v)?|-|v)2(?:\.0)?", None),
    ("epl-1.0", "~short", r"epl(?:,? (?:version |v)?|-|v)1(?:\.0)?", None),
    ("epl-2.0", "~short", r"epl(?:,? (?:version |v)?|-|v)2(?:\.0)?", None),
    ("eupl-1.2", "~short", r"eupl(?:,? (?:version |v)?|-|v)1\.2", None),
    ("cddl-1.0", "~short", r"cddl(?:,? (?:version |v)?|-|v)1(?:\.0)?", None),
    ("apache-2.0", "~short", r"(?:apache|asl)[- ](?:version |v)?2(?:\.0)?", None),
    ("bsd-2-clause", "freebsd", r"freebsd licen[sc]e", None),
    ("bsd-2-clause", "bsd", r"two[- ]clause bsd(?: licen[sc]e)?", None),
    ("bsd-3-clause", "bsd", r"three[- ]clause bsd(?: licen[sc]e)?", None),
    ("mit", "expat", r"expat licen[sc]e", None),
    ("apsl-2.0", "apple public", r"apple public source licen[sc]e,? (?:version |v)?2(?:\.0)?", r"opensource\.apple\.com/apsl"),
    ("afl-3.0", "academic free", r"academic free licen[sc]e,? (?:version |v)?3(?:\.0)?", r"opensource\.org/licenses?/afl-3\.0"),
    ("ecl-2.0", "educational community", r"educational community licen[sc]e,? (?:version |v)?2(?:\.0)?", r"opensource\.org/licenses?/ecl-2\.0"),
    ("efl-2.0", "eiffel forum", r"eiffel forum licen[sc]e,? (?:version |v)?2(?:\.0)?", None),
    ("ipl-1.0", "ibm public", r"ibm public licen[sc]e(?:,? (?:version |v)?1(?:\.0)?)?", r"opensource\.org/licenses?/ipl-1\.0"),
    ("lppl-1.3c", "latex project", r"latex project public licen[sc]e(?:,? (?:version |v)?1\.3c?)?", r"latex-project\.org/lppl"),
    ("naist-2003", "nara institute", r"nara institute of science and technology licen[sc]e", None),
    ("ntp", "ntp", r"ntp licen[sc]e", None),
    ("nasa-1.3", "nasa open", r"nasa open source agreement(?:,? (?:version |v)?1\.3)?", None),
    ("qpl-1.0", "q public", r"q public licen[sc]e(?:,? (?:version |v)?1(?:\.0)?)?", None),
    ("rpl-1.5", "reciprocal public", r"reciprocal public licen[sc]e(?:,? (?:version |v)?1\.5)?", None),
    ("sleepycat", "sleepycat", r"sleepycat licen[sc]e", None),
    ("sun-public-1.0", "sun public", r"sun public licen[sc]e(?:,? (?:version |v)?1(?:\.0)?)?", None),
    ("spl-1.0", "sybase open", r"sybase open watcom public licen[sc]e", None),
    ("zpl-2.1", "zope public", r"zope public licen[sc]e(?:,? (?:version |v)?2\.1)?", r"opensource\.org/licenses?/zpl"),
    ("mulan-psl-2.0", "mulan", r"mulan permissive software licen[sc]e(?:,? (?:version |v)?2)?", r"license\.coscl\.org\.cn/mulanpsl2"),
    ("blueoak-1.0.0", "blue oak", r"blue oak model licen[sc]e(?:,? (?:version |v)?1(?:\.0){0,2})?", r"blueoakcouncil\.org/license/1\.0\.0"),
    ("parity-7.0.0", "parity public", r"parity public licen[sc]e", None),
    ("polyform-noncommercial-1.0.0", "polyform", r"polyform noncommercial licen[sc]e", r"polyformproject\.org/licenses/noncommercial"),
    ("commons-clause", "commons clause", r"commons clause(?: licen[sc]e)?", r"commonsclause\.com"),
    ("openrail-m", "openrail", r"(?:bigscience )?(?:bloom )?open ?rail(?:-| )?m?(?: licen[sc]e)?", r"huggingface\.co/spaces/bigscience/license"),
    ("hippocratic-2.1", "hippocratic", r"hippocratic licen[sc]e(?:,? (?:version |v)?2\.1)?", r"firstdonoharm\.dev"),
    ("jrl", "java research", r"java research licen[sc]e", None),
    ("beerware", "beer", r"beer-?ware licen[sc]e", None),
    ("curl", "curl", r"curl licen[sc]e", r"curl\.se/docs/copyright"),
    ("hpnd", "historical permission", r"historical permission notice and disclaimer", None),
    ("icu", "icu", r"icu licen[sc]e", None),
    ("json", "json", r"json licen[sc]e", r"json\.org/license"),
    ("unicode-3.0", "unicode", r"unicode licen[sc]e(?:,? (?:version |v)?3)?", r"unicode\.org/license"),
    ("sgi-b-2.0", "sgi free", r"sgi free software licen[sc]e b", None),
    ("tcl", "tcl", r"tcl/tk licen[sc]e", r"tcl\.tk/software/tcltk/license"),
    ("watcom-1.0", "watcom", r"open watcom licen[sc]e", None),
    ("xfree86-1.1", "xfree86", r"xfree86 licen[sc]e(?:,? (?:version |v)?1\.1)?", None),
    ("cc0-1.0", "cc0", r"cc0(?:[ -]1\.0)?(?: universal)?", r"creativecommons\.org/publicdomain/zero/1\.0"),
)

#: (label, two keywords of every match, words of a passage of the licence's own text as they follow each other, whatever stands between them)
BODIES = (
    ("mit", "hereby", "permission", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "permission", "copyright", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("x11", "authorization", "software", "shall not be used in advertising or otherwise to promote the sale use or other dealings in this software without prior written authorization"),
    ("isc", "hereby", "permission", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", "hereby", "permission", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd-any", "redistribut", "permitted", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd-any", "redistribut", "copyright", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd-any", "redistribut", "copyright", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd-3-clause", "permission", "endorse", "may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-4-clause", "advertising", "software", "all advertising materials mentioning features or use of this software must display the following acknowledgement"),
    ("zlib", "warranty", "software", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"),
    ("zlib", "redistribut", "permission", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely"),
    ("apache-2.0", "hereby", "contributor", "subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license"),
    ("apache-2.0", "licen", "apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("apache-1.1", "apache", "software", "this product includes software developed by the apache software foundation"),
    ("gpl-any", "redistribut", "program", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl-any", "licen", "verbatim", "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed"),
    ("gpl-2.0", "licen", "version 2", "either version 2 of the license or at your option any later version"),
    ("gpl-3.0", "licen", "version 3", "either version 3 of the license or at your option any later version"),
    ("lgpl-2.1", "redistribut", "library", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("agpl-3.0", "redistribut", "affero", "you can redistribute it and or modify it under the terms of the gnu affero general public license"),
    ("mpl-2.0", "licen", "mozilla", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-1.1", "licen", "mozilla", "the contents of this file are subject to the mozilla public license version 1 1"),
    ("epl-1.0", "licen", "eclipse", "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0"),
    ("epl-2.0", "licen", "eclipse", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0"),
    ("cddl-1.0", "licen", "development", "the contents of this file are subject to the terms of the common development and distribution license"),
    ("eupl-1.2", "licen", "eupl", "licensed under the eupl"),
    ("bsl-1.0", "hereby", "permission", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("unlicense", "public domain", "software", "this is free and unencumbered software released into the public domain"),
    ("cc0-1.0", "copyright", "waived", "has waived all copyright and related or neighboring rights to this work"),
    ("ofl-1.1", "licen", "font", "this font software is licensed under the sil open font license version 1 1"),
    ("postgresql", "hereby", "permission", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    ("ncsa", "hereby", "permission", "to deal with the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense"),
    ("python-2.0", "hereby", "licen", "hereby grants licensee a nonexclusive royalty free world wide license to reproduce analyze test perform and or display publicly"),
    ("openssl", "openssl", "software", "this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("php-3.01", "php", "software", "this product includes php software freely available from"),
    ("artistic-1.0", "copyright", "package", "the intent of this document is to state the conditions under which a package may be copied such that the copyright holder maintains some semblance of artistic control"),
    ("artistic-2.0", "licen", "package", "this license establishes the terms under which a given free software package may be copied modified distributed and or redistributed"),
    ("w3c", "licen", "work", "by obtaining and or copying this work you the licensee agree that you have read understood and will comply with the following terms and conditions"),
    ("upl-1.0", "hereby", "copyright", "to any person obtaining a copy of this software associated documentation and or data collectively the software free of charge and under any and all copyright rights in the software"),
    ("vim", "restrictions", "copies", "there are no restrictions on distributing unmodified copies of vim"),
)

_CC = ("by", "by-sa", "by-nc", "by-nd", "by-nc-sa", "by-nc-nd")
_CC_NAMES = {"by": "attribution", "sa": "sharealike", "nc": "non-?commercial", "nd": "no-?deriv(?:ative)?s"}
#: Gates of rules that no few keywords can gate: a regex over the lower-case text, tried where it holds the keyword before it.
GATES = {
    "~spdx": ("", "spdx-license-identifier:"),
    "~manifest": ("licen", r"""licen[sc]es?["']?\s{0,3}[:=]\s{0,3}["'\[({]{0,3}[a-z0-9]"""),
    "~dual": ("licen", r"(?:dual|multi|tri)[- ]licen[sc]ed"),
    "~short": ("", r"(?:apache|bsd|gpl|mpl|epl|cddl|eupl|asl|artistic|bsl)(?:,? (?:version |v)?|[- ]?v|-)[0-9]"),
}
#: What may stand between a tag and an identifier: other identifiers of an expression.
_BEFORE = r"(?:[\w.+-]{1,40}\)?(?:\s(?:and|or|with)\s|\s?/\s?|,\s?)\(?)?" * 4  # written out, as a lookbehind can't hold a repeated group
_GRANT = r"(?:licen[sc]ed|released|distributed|available|published|provided|covered)\s+(?:to you\s+)?(?:under|by)\s+(?:the\s+)?(?:terms\s+of\s+)?(?:the\s+)?"


def _creative_commons() -> list[tuple[str, str, str, str]]:
    out = []
    for version in ("1.0", "2.0", "2.5", "3.0", "4.0"):
        v = version.replace(".", r"\.") if not version.endswith(".0") else rf"{version[0]}(?:\.0)?"
        for parts in _CC:
            long = r"[ -]".join(_CC_NAMES[p] for p in parts.split("-"))
            for sep in " -":
                out.append((f"cc-{parts}-{version}", f"cc{sep}{parts}", rf"cc{sep}{parts}[ -]{v}", rf"creativecommons\.org/licenses/{parts}/{version[0]}\.{version[2]}" if sep == " " else ""))
            out.append((f"cc-{parts}-{version}", "creative commons", rf"creative commons {long}(?: international| unported)? {v}", ""))
    return out


def rules() -> list[Rule]:
    """All rules in order; a name ends where a word ends."""
    start, end = f"(?i)(?<!{WORD})", f"(?!{WORD})"
    out: list[Rule] = []
    tagged: set[str] = set()
    for phrase, label in BASE_PHRASES:
        out.append(Rule(label, 2, phrase.split()[0], start + f"{OTHER}+".join(phrase.split()) + end, True, phrase.split()[-1]))
    for label, also, keyword, words in BODIES:
        out.append(Rule(label, 1, keyword, start + f"{OTHER}+".join(words.split()) + end, also=also))
    for label, keyword, name, address in (*LICENCES, *_creative_commons()):
        spaced = name if keyword.startswith(("cc by", "cc-by")) else re.sub(r"(?<!\[) ", r"\\s+", name)
        also = "licen" if "licen[sc]e" in name and "?: licen[sc]e)?" not in name else ""
        if keyword.startswith(("cc by", "cc-by")):
            also = keyword[:5]
        elif " " in keyword and not keyword.startswith("~"):  # words may stand apart by any white space
            keyword, also = max(keyword.split(), key=len), also or min(keyword.split(), key=len)
        if address != "" and label not in tagged:  # once for each identifier
            tagged.add(label)
            own = rf"(?i)(?<![\w.-]){re.escape(label)}(?:-only|-or-later|\+)?(?![\w+-]|\.\w)"
            out.append(Rule(label, 0, "~spdx", rf"{own}(?<=spdx-license-identifier:[ \t]{{0,4}}\(?{_BEFORE}{re.escape(label)}(?:-only|-or-later|\+)?)"))
            out.append(Rule(label, 1, "~manifest", rf"""{own}(?<=licen[sc]es?["']?\s{{0,3}}[:=]\s{{0,3}}["'\[({{]{{0,3}}{_BEFORE}{re.escape(label)}(?:-only|-or-later|\+)?)"""))
            out.append(Rule(label, 1, "~dual", rf"{own}(?<=(?:dual|multi|tri)[- ]licen[sc]ed[ ](?:under[ ])?(?:the[ ])?\(?{_BEFORE}{re.escape(label)}(?:-only|-or-later|\+)?)"))
            if label in ("mit", "isc", "zlib"):  # a word of its own beside another identifier only
                out.append(Rule(label, 3, "~short", rf"{own}(?<=[a-z0-9]-[\w.+-]{{1,20}}\)?[ ](?:and|or)[ ]\(?{label})"))
            elif re.match("(?:apache|bsd|l?gpl|agpl|mpl|epl|cddl|eupl|artistic|bsl)-[0-9]", label):
                out.append(Rule(label, 3, "~short", own))
        out.append(Rule(label, 1, keyword, rf"{start}{_GRANT}{spaced}{end}", also=also))
        out.append(Rule(label, 3, keyword, rf"{start}{spaced}{end}", also=also))
        if address:
            out.append(Rule(label, 2, address.split("/")[0].replace("\\", ""), rf"(?i)https?://(?:www\.)?{address}", also="http"))
    return out
