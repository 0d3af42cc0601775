"""The ordered signature rules of the license scan.

A rule is a regular expression over a text's words, in lower case and joined by
single spaces ("2.0" is "2 0"). Rules are in tiers, the surest first: tags and
wordings of license texts, grants ("released under the ..."), addresses, names,
and general notices. A rule names a keyword, a plain string that each of its
matches holds: only texts with that keyword are searched for it.
"""

from __future__ import annotations

from functools import cache
from typing import NamedTuple

TAG, GRANT, NAME, NOTICE = 0, 1, 2, 3


class Rule(NamedTuple):
    label: str
    tier: int
    score: float
    keyword: str
    pattern: str


#: The words of a license's own text that stand in no other's: label, keyword, pattern.
WORDINGS = [
    ("mit", "permission", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "permission", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit-0", "permission", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided"),
    ("isc", "permission", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice"),
    ("0bsd", "permission", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided"),
    ("hpnd", "permission", "permission to use copy modify and distribute this software and its documentation for any purpose (?:and )?without fee is hereby granted"),
    ("bsd-2-clause", "redistribut", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution this software is provided"),
    ("bsd", "redistribut", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd-3-clause", "endorse", "neither the names? of (?:[^ ]+ ){1,12}nor the names of (?:its|the) contributors may be used to endorse or promote products derived from this software"),
    ("bsd-4-clause", "advertising", "all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("bsd-3-clause-clear", "patent", "no express or implied licenses to any party s patent rights are granted by this license"),
    ("apache-2.0", "licen", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("apache-2.0", "licen", "you may obtain a copy of the license at https? www apache org licenses license 2 0"),
    ("apache-1.1", "apache", "the end user documentation included with the redistribution if any must include the following acknowledge?ment this product includes software developed by the apache software foundation"),
    ("gpl", "general public licen", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl-2.0-or-later", "general public licen", "gnu general public license as published by the free software foundation either version 2 (?:of the license )?or at your option any later version"),
    ("gpl-3.0-or-later", "general public licen", "gnu general public license as published by the free software foundation either version 3 (?:of the license )?or at your option any later version"),
    ("gpl-2.0-only", "general public licen", "gnu general public license version 2 (?:only )?as published by the free software foundation"),
    ("lgpl-2.1-or-later", "general public licen", "gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version"),
    ("lgpl-3.0-or-later", "general public licen", "gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("agpl-3.0-or-later", "general public licen", "gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gfdl", "documentation licen", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("mpl-2.0", "licen", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-1.1", "licen", "the contents of this file are subject to the mozilla public license version 1 1"),
    ("cddl-1.0", "licen", "the contents of this file are subject to the terms of the common development and distribution license"),
    ("epl-2.0", "eclipse", "this program and the accompanying materials are made available under the terms of the eclipse public license (?:v|version) ?2 0"),
    ("epl-1.0", "eclipse", "this program and the accompanying materials are made available under the terms of the eclipse public license (?:v|version) ?1 0"),
    ("unlicense", "public domain", "this is free and unencumbered software released into the public domain"),
    ("cc0-1.0", "public domain", "the person who associated a work with this deed has dedicated the work to the public domain"),
    ("cc0-1.0", "copyright", "to the extent possible under law (?:[^ ]+ ){1,12}(?:has|have) waived all copyright and related or neighboring rights"),
    ("wtfpl", "what the fuck", "you just do what the fuck you want to"),
    ("zlib", "warrant", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"),
    ("libpng", "png reference library", "the png reference library is supplied as is"),
    ("bsl-1.0", "permission", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("ncsa", "permission", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal with the software without restriction"),
    ("unicode", "permission", "permission is hereby granted free of charge to any person obtaining a copy of the unicode data files"),
    ("ofl-1.1", "font software", "permission is hereby granted free of charge to any person obtaining a copy of the font software"),
    ("ofl-1.1", "font software", "this font software is licensed under the sil open font license version 1 1"),
    ("artistic-1.0", "artistic", "the intent of this document is to state the conditions under which a package may be copied such that the copyright holder maintains some semblance of artistic control"),
    ("artistic-2.0", "permitted", "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed preamble this license establishes the terms under which a given free software package may be copied"),
    ("openssl", "openssl toolkit", "this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("php-3.01", "redistribut", "redistribution and use in source and binary forms with or without modification is permitted provided that the following conditions are met"),
    ("python-2.0", "python", "psf is making python available to licensee on an as is basis"),
    ("ms-pl", "licen", "this license governs use of the accompanying software if you use the software you accept this license"),
    ("beerware", "beer", "if we meet some day and you think this stuff is worth it you can buy me a beer in return"),
    ("elastic-2.0", "managed service", "you may not provide the software to third parties as a hosted or managed service"),
    ("busl-1.1", "production use", "the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work"),
    ("sspl-1.0", "service source code", "if you make the functionality of the program or a modified version available to third parties as a service you must make the service source code available"),
    ("openrail", "rail", "use restrictions? (?:set forth )?(?:in|of) (?:the )?(?:[^ ]+ )?openrail"),
    ("openrail", "responsible ai licen", "use restrictions? (?:set forth )?(?:in|of) (?:the )?(?:[^ ]+ )?responsible ai license"),
    ("llama", "licensed under the", "(?:meta )?llama (?:[0-9 ]+)?is licensed under the llama (?:[0-9 ]+)?(?:community )?license"),
]

#: label, keyword, names as a pattern, tag: names are searched bare and after "under the".
V = "(?:version |v )?"
NAMES = [
    ("mit", "mit licen", "mit licen[cs]es?", "mit"),
    ("mit", "expat licen", "expat licen[cs]e", "expat"),
    ("mit-0", "attribution licen", "mit no attribution licen[cs]e", "mit 0"),
    ("x11", "x11 licen", "x11 licen[cs]e", "x11"),
    ("isc", "isc licen", "isc licen[cs]e", "isc"),
    ("0bsd", "bsd", "(?:0bsd|zero clause bsd)(?: licen[cs]e)?", "0bsd"),
    ("bsd", "bsd licen", "bsd licen[cs]e", "bsd"),
    ("bsd-1-clause", "clause", "(?:bsd (?:1|one) clause|(?:1|one) clause bsd)(?: licen[cs]e)?", "bsd 1 clause"),
    ("bsd-2-clause", "clause", "(?:bsd (?:2|two) clause|(?:2|two) clause bsd)(?: licen[cs]e)?", "bsd 2 clause"),
    ("bsd-2-clause", "bsd licen", "(?:simplified|freebsd) bsd licen[cs]e|freebsd licen[cs]e", "bsd 2 clause freebsd"),
    ("bsd-3-clause", "clause", "(?:bsd (?:3|three) clause|(?:3|three) clause bsd)(?: licen[cs]e)?", "bsd 3 clause"),
    ("bsd-3-clause", "bsd licen", "(?:new|modified|revised) bsd licen[cs]e", "bsd 3 clause modification"),
    ("bsd-4-clause", "clause", "(?:bsd (?:4|four) clause|(?:4|four) clause bsd)(?: licen[cs]e)?", "bsd 4 clause"),
    ("bsd-3-clause-clear", "clear bsd licen", "(?:the )?clear bsd licen[cs]e", "bsd 3 clause clear"),
    ("apache", "apache", "apache (?:software )?licen[cs]e", "apache"),
    ("apache-1.0", "apache", f"apache (?:software )?(?:licen[cs]e )?{V}1 0", "apache 1 0"),
    ("apache-1.1", "apache", f"apache (?:software )?(?:licen[cs]e )?{V}1 1", "apache 1 1"),
    ("apache-2.0", "apache", f"apache (?:software )?(?:licen[cs]e )?{V}2(?: 0)?", "apache 2 0"),
    ("gpl", "general public licen", "(?:gnu )?general public licen[cs]e", "gpl"),
    ("gpl", "gpl", "(?:gnu )?gpl(?: licen[cs]e)?", "gnu gpl"),
    ("gpl-1.0", "general public licen", f"(?:gnu )?general public licen[cs]e {V}1(?: 0)?", "gpl 1 0(?: only| or later)?"),
    ("gpl-2.0", "general public licen", f"(?:gnu )?general public licen[cs]e {V}2(?: 0)?", "gpl 2 0(?: only)?"),
    ("gpl-2.0", "gpl", f"(?:gnu )?(?:gplv2|gpl {V}2(?: 0)?)", "gplv2"),
    ("gpl-2.0-or-later", "gpl", f"(?:gnu )?(?:gplv2|gpl {V}2(?: 0)?) or (?:any )?later(?: version)?", "gpl 2 0 or later"),
    ("gpl-3.0", "general public licen", f"(?:gnu )?general public licen[cs]e {V}3(?: 0)?", "gpl 3 0(?: only)?"),
    ("gpl-3.0", "gpl", f"(?:gnu )?(?:gplv3|gpl {V}3(?: 0)?)", "gplv3"),
    ("gpl-3.0-or-later", "gpl", f"(?:gnu )?(?:gplv3|gpl {V}3(?: 0)?) or (?:any )?later(?: version)?", "gpl 3 0 or later"),
    ("gpl-classpath-exception", "classpath exception", "(?:with )?(?:the )?classpath exception", "gpl 2 0 with classpath exception"),
    ("lgpl", "general public licen", "(?:gnu )?(?:lesser|library) general public licen[cs]e", "lgpl"),
    ("lgpl", "lgpl", "(?:gnu )?lgpl(?: licen[cs]e)?", "gnu lgpl"),
    ("lgpl-2.0", "general public licen", f"(?:gnu )?library general public licen[cs]e {V}2(?: 0)?", "lgpl 2 0(?: only| or later)?"),
    ("lgpl-2.1", "general public licen", f"(?:gnu )?lesser general public licen[cs]e {V}2 1", "lgpl 2 1(?: only)?"),
    ("lgpl-2.1", "lgpl", f"(?:gnu )?lgpl(?: {V}2 1|v2 1)", "lgpl 2 1 plus"),
    ("lgpl-3.0", "general public licen", f"(?:gnu )?lesser general public licen[cs]e {V}3(?: 0)?", "lgpl 3 0(?: only)?"),
    ("lgpl-3.0", "lgpl", f"(?:gnu )?(?:lgplv3|lgpl {V}3(?: 0)?)", "lgpl 3 0 or later"),
    ("agpl", "agpl", "(?:gnu )?agpl(?: licen[cs]e)?", "agpl"),
    ("agpl-3.0", "general public licen", f"(?:gnu )?affero general public licen[cs]e(?: {V}3(?: 0)?)?", "agpl 3 0(?: only)?"),
    ("agpl-3.0", "agpl", f"(?:gnu )?(?:agplv3|agpl {V}3(?: 0)?)", "agpl 3 0 or later"),
    ("gfdl", "documentation licen", "(?:gnu )?free documentation licen[cs]e", "gfdl"),
    ("gfdl", "gfdl", "gfdl", "gfdl 1 [123](?: only| or later)?"),
    ("mpl", "mozilla public licen", "mozilla public licen[cs]e", "mpl"),
    ("mpl-1.1", "mozilla public licen", f"mozilla public licen[cs]e {V}1 1", "mpl 1 1"),
    ("mpl-2.0", "mozilla public licen", f"mozilla public licen[cs]e {V}2(?: 0)?", "mpl 2 0"),
    ("npl", "netscape public licen", f"netscape public licen[cs]e(?: {V}1 [01])?", "npl 1 [01]"),
    ("epl", "eclipse public licen", "eclipse public licen[cs]e", "epl"),
    ("epl-1.0", "eclipse public licen", f"eclipse public licen[cs]e {V}1(?: 0)?", "epl 1 0"),
    ("epl-2.0", "eclipse public licen", f"eclipse public licen[cs]e {V}2(?: 0)?", "epl 2 0"),
    ("edl-1.0", "eclipse distribution licen", f"eclipse distribution licen[cs]e(?: {V}1 0)?", "edl 1 0"),
    ("eupl", "european union public licen", f"european union public licen[cs]e(?: {V}1 [012])?", "eupl 1 [012]"),
    ("eupl", "eupl", "eupl", "eupl"),
    ("cddl", "common development and distribution licen", "common development and distribution licen[cs]e", "cddl"),
    ("cddl", "cddl", f"cddl(?: {V}1 [01])?", "cddl 1 [01]"),
    ("cpl-1.0", "common public licen", f"common public licen[cs]e(?: {V}1 0)?", "cpl 1 0"),
    ("cpal-1.0", "common public attribution licen", f"common public attribution licen[cs]e(?: {V}1 0)?", "cpal 1 0"),
    ("ipl-1.0", "ibm public licen", f"ibm public licen[cs]e(?: {V}1 0)?", "ipl 1 0"),
    ("osl-3.0", "open software licen", f"open software licen[cs]e(?: {V}3 0)?", "osl 3 0"),
    ("afl-3.0", "academic free licen", f"academic free licen[cs]e(?: {V}3 0)?", "afl 3 0"),
    ("apsl-2.0", "apple public source licen", f"apple public source licen[cs]e(?: {V}2 0)?", "apsl 2 0"),
    ("artistic", "artistic licen", "artistic licen[cs]e", "artistic"),
    ("artistic-1.0", "artistic licen", f"artistic licen[cs]e {V}1 0", "artistic 1 0(?: perl)?"),
    ("artistic-2.0", "artistic licen", f"artistic licen[cs]e {V}2(?: 0)?", "artistic 2 0"),
    ("bsl-1.0", "boost software licen", f"boost software licen[cs]e(?: {V}1 0)?", "bsl 1 0"),
    ("zlib", "zlib", "zlib(?: libpng)? licen[cs]e", "zlib"),
    ("libpng", "libpng licen", "libpng licen[cs]e", "libpng(?: 2 0)?"),
    ("openssl", "openssl licen", "openssl licen[cs]e", "openssl"),
    ("python-2.0", "python", "python (?:software foundation )?licen[cs]e", "(?:python|psf) 2 0"),
    ("php-3.01", "php licen", f"php licen[cs]e(?: {V}3 01?)?", "php 3 01"),
    ("ruby", "ruby licen", "ruby licen[cs]e", "ruby"),
    ("perl", "same terms as perl", "(?:under )?the same terms as perl(?: itself)?", "artistic 1 0 or gpl 1 0"),
    ("postgresql", "postgresql licen", "postgresql licen[cs]e", "postgresql"),
    ("ncsa", "ncsa", "university of illinois ncsa open source licen[cs]e|ncsa licen[cs]e", "ncsa"),
    ("upl-1.0", "universal permissive licen", f"universal permissive licen[cs]e(?: {V}1 0)?", "upl 1 0"),
    ("unlicense", "unlicense", "(?:the )?unlicense", "unlicense"),
    ("wtfpl", "wtfpl", "wtfpl", "wtfpl"),
    ("wtfpl", "what the fuck", "do what the fuck you want to public licen[cs]e", "wtfpl 2"),
    ("beerware", "beerware", "beerware(?: licen[cs]e)?", "beerware"),
    ("ofl-1.1", "open font licen", f"(?:sil )?open font licen[cs]e(?: {V}1 1)?", "ofl 1 1"),
    ("lppl", "latex project public licen", f"latex project public licen[cs]e(?: {V}1 3[ac]?)?", "lppl 1 3[ac]?"),
    ("ms-pl", "microsoft public licen", "microsoft public licen[cs]e", "ms pl"),
    ("ms-rl", "microsoft reciprocal licen", "microsoft reciprocal licen[cs]e", "ms rl"),
    ("mulan-psl-2.0", "mulan", f"mulan (?:permissive software licen[cs]e|psl)(?: {V}2)?", "mulanpsl 2 0"),
    ("elastic-2.0", "elastic licen", f"elastic licen[cs]e(?: {V}2(?: 0)?)?", "elastic 2 0"),
    ("sspl-1.0", "server side public licen", f"server side public licen[cs]e(?: {V}1)?", "sspl 1 0"),
    ("busl-1.1", "business source licen", f"business source licen[cs]e(?: {V}1 1)?", "busl 1 1"),
    ("odbl-1.0", "open database licen", f"open database licen[cs]e(?: {V}1 0)?", "odbl 1 0"),
    ("odc-by-1.0", "open data commons attribution licen", f"open data commons attribution licen[cs]e(?: {V}1 0)?", "odc by 1 0"),
    ("pddl-1.0", "public domain dedication", "(?:open data commons )?public domain dedication and licen[cs]e", "pddl 1 0"),
    ("cdla", "community data licen", f"community data licen[cs]e agreement(?: permissive| sharing)?(?: {V}[12] 0)?", "cdla (?:permissive|sharing) [12] 0"),
    ("ogl-uk", "open government licen", f"open government licen[cs]e(?: {V}[123] 0)?", "ogl uk [123] 0"),
    ("openrail", "rail", "(?:creativeml |bigscience |bigcode )?open ?rail(?: m)?(?: licen[cs]e)?", "(?:big ?science|creativeml|bigcode) open ?rail m"),
    ("llama", "llama", "llama (?:[0-9]+ (?:[0-9]+ )?)?community licen[cs]e(?: agreement)?", "llama[0-9]?"),
    ("cc", "creative commons", "creative commons(?: licen[cs]e)?", "cc"),
    ("cc0-1.0", "cc0", f"cc0(?: {V}1 0)?(?: universal)?", "cc0 1 0"),
    ("cc-pdm", "public domain mark", f"public domain mark(?: {V}1 0)?", "pdm 1 0"),
    ("public-domain", "public domain", "(?:in|into|to) the public domain", "public domain"),
    ("proprietary", "proprietary", "proprietary and confidential", "licenseref proprietary"),
]

#: Creative Commons licenses are their parts: the tag's words and the long names.
PARTS = {"nc": ("nc", "non ?commercial"), "nd": ("nd", "no ?deriv(?:ative)?s?"), "sa": ("sa", "share ?alike")}
COMMONS = [(), ("nc",), ("nd",), ("sa",), ("nc", "nd"), ("nc", "sa")]
VERSIONS = ["1 0", "2 0", "2 5", "3 0", "4 0"]

#: Addresses: label, keyword, pattern.
ADDRESSES = [
    ("mit", "opensource org", "opensource org licenses? mit(?: license)?"),
    ("isc", "opensource org", "opensource org licenses? isc"),
    ("bsd-2-clause", "opensource org", "opensource org licenses? bsd 2 clause"),
    ("bsd-3-clause", "opensource org", "opensource org licenses? bsd 3 clause"),
    ("apache-2.0", "apache org licen", "apache org licenses license 2 0"),
    ("apache-2.0", "opensource org", "opensource org licenses? apache 2 0"),
    ("gpl", "gnu org", "gnu org (?:licenses gpl|copyleft gpl)"),
    ("gpl-2.0", "gnu org", "gnu org licenses (?:old licenses )?gpl 2 0"),
    ("gpl-3.0", "gnu org", "gnu org licenses gpl 3 0"),
    ("lgpl", "gnu org", "gnu org (?:licenses lgpl|copyleft lesser)"),
    ("lgpl-2.1", "gnu org", "gnu org licenses (?:old licenses )?lgpl 2 1"),
    ("agpl-3.0", "gnu org", "gnu org licenses agpl(?: 3 0)?"),
    ("gfdl", "gnu org", "gnu org (?:licenses fdl|copyleft fdl)"),
    ("mpl-2.0", "mozilla org", "mozilla org (?:en us )?mpl 2 0"),
    ("mpl-1.1", "mozilla org", "mozilla org mpl mpl 1 1"),
    ("epl-1.0", "eclipse org", "eclipse org legal epl v10"),
    ("epl-2.0", "eclipse org", "eclipse org legal epl (?:v20|2 0)"),
    ("bsl-1.0", "boost org", "boost org license 1 0"),
    ("unlicense", "unlicense org", "unlicense org"),
    ("wtfpl", "wtfpl net", "wtfpl net"),
    ("ofl-1.1", "sil org", "scripts sil org(?: ofl)?"),
    ("ofl-1.1", "openfontlicense org", "openfontlicense org"),
    ("cc0-1.0", "creativecommons org", "creativecommons org publicdomain zero 1 0"),
    ("cc-pdm", "creativecommons org", "creativecommons org publicdomain mark 1 0"),
    ("odbl-1.0", "opendatacommons org", "opendatacommons org licenses odbl(?: 1 0)?"),
    ("pddl-1.0", "opendatacommons org", "opendatacommons org licenses pddl(?: 1 0)?"),
]

NOTICES = [
    ("all-rights-reserved", "rights reserved", "all rights reserved"),
    ("some-rights-reserved", "rights reserved", "some rights reserved"),
    ("copyright", "copyright", "copyright (?:c )?(?:19|20)[0-9][0-9]"),
    ("other-permissive", "warrant", "without warranty of any kind"),
    ("other-permissive", "warrant", "(?:as is )?without warranties or conditions of any kind"),
    ("commercial", "commercial licen", "commercial licen[cs]e"),
    ("non-commercial", "commercial use", "(?:for )?non ?commercial use(?: only)?"),
    ("free-use", "free to use", "free to use (?:copy )?(?:modify )?(?:and )?(?:distribute|share)"),
]

#: Parts of keywords: a text without any of these, and without the keywords that
#: hold none of them, is searched for no rule.
STEMS = ("licen", "gpl", " org", "permi", "redistribut", "apache", "public domain", "copyright", "warrant", "spdx", "bsd", "clause", "reserved", "commercial", "creative commons", "cc by")

UNDER = "(?:licen[cs]ed|released|distributed|available|published|provided|covered|offered|shared|redistributed|open sourced) under (?:a |an |the )?(?:terms (?:and conditions )?of )?(?:the )?"


@cache
def rules() -> tuple[Rule, ...]:
    """All rules in their order: by tier, in a tier as they stand above."""
    out = [Rule(label, TAG, 0.99, keyword, pattern) for label, keyword, pattern in WORDINGS]
    out += [Rule(label, TAG, 1.0, "spdx", f"spdx license identifier {tag}") for label, _, _, tag in NAMES]
    out += [Rule(label, GRANT, 0.9, keyword, pattern) for label, keyword, pattern in ADDRESSES]
    for label, keyword, names, _ in NAMES:
        out += [Rule(label, GRANT, 0.95, keyword, f"{UNDER}(?:{names})"), Rule(label, NAME, 0.8, keyword, names)]
    for parts in COMMONS:
        short, long = (" ".join(["", *(PARTS[p][i] for p in parts)]) for i in (0, 1))
        for version in ["", *VERSIONS]:
            label, end = "-".join(["cc-by", *parts, *([version.replace(" ", ".")] if version else [])]), f" {version}" if version else ""
            named = f"creative commons attribution{long}(?: international| unported| generic)?(?: licen[cs]e)?" + (f" (?:international |unported |generic )?{V}{version}" if version else "")
            out += [Rule(label, NAME, 0.85, "cc by", f"cc by{short}{end}"), Rule(label, GRANT, 0.95, "cc by", f"{UNDER}cc by{short}{end}"), Rule(label, NAME, 0.85, "creative commons", named)]
            if version:
                out.append(Rule(label, GRANT, 0.95, "creativecommons org", f"creativecommons org licenses by{short} {version}"))
    out += [Rule(label, NOTICE, 0.4, keyword, pattern) for label, keyword, pattern in NOTICES]
    return tuple(sorted(out, key=lambda r: r.tier))


def gates() -> list[str]:
    """Strings one of which stands in every text that a rule matches."""
    return sorted({next((s for s in STEMS if s in r.keyword), r.keyword) for r in rules()})
