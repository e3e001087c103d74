"""Signature rules of the license scan: regular expressions over normalised words (lower case, single spaces).

A rule is tried where its keyword stands, ``lead`` words behind the start of its pattern, in
documents that hold all words of ``needs``. A lower priority number wins. The rules of a license
are built from its rows in NAMES by three forms (an SPDX tag, a notice, a mention of the name);
links and the wording of licenses have rules of their own.
"""

from __future__ import annotations

import re
from typing import NamedTuple

#: Words of the longest match; gaps in patterns are bounded so that none is longer.
REACH = 40

TEXT, TAG, NOTICE, LINK, NAME, GENERIC = range(6)
#: How surely a detection of each priority tells the license.
CONFIDENCE = (1.0, 1.0, 0.9, 0.9, 0.6, 0.3)


class Rule(NamedTuple):
    order: int
    keyword: str
    lead: int
    needs: tuple[str, ...]
    pattern: str
    label: str
    priority: int
    base: bool


#: label, pattern of the name (it starts with a literal word), words of the SPDX identifier where the row has one.
NAMES = [
    ("0bsd", "zero clause bsd(?: licen[cs]e)?", "0bsd"),
    ("afl-2.1", "academic free licen[cs]e (?:version |v )?2 1", "afl 2 1"),
    ("afl-3.0", "academic free licen[cs]e (?:version |v )?3(?: 0)?", "afl 3 0"),
    ("agpl", "affero general public licen[cs]e", ""),
    ("agpl-3.0", "affero general public licen[cs]e (?:version |v )?3(?: 0)?", "agpl 3 0"),
    ("agpl-3.0", "agpl (?:version |v )?3(?: 0)?", "agpl 3 0 only"),
    ("agpl-3.0", "agplv3", ""),
    ("agpl-3.0-or-later", "affero general public licen[cs]e (?:version |v )?3(?: 0)? or (?:any )?later", "agpl 3 0 or later"),
    ("apache", "apache (?:software )?licen[cs]e", ""),
    ("apache-1.0", "apache (?:software )?licen[cs]e (?:version |v )?1 0", "apache 1 0"),
    ("apache-1.1", "apache (?:software )?licen[cs]e (?:version |v )?1 1", "apache 1 1"),
    ("apache-2.0", "apache (?:software )?licen[cs]e (?:version |v )?2(?: 0)?", "apache 2 0"),
    ("apple-apsl-2.0", "apple public source licen[cs]e(?: (?:version |v )?2(?: 0)?)?", "apsl 2 0"),
    ("artistic", "artistic licen[cs]e", ""),
    ("artistic-1.0", "artistic licen[cs]e (?:version |v )?1(?: 0)?", "artistic 1 0"),
    ("artistic-2.0", "artistic licen[cs]e (?:version |v )?2(?: 0)?", "artistic 2 0"),
    ("beerware", "beerware licen[cs]e", "beerware"),
    ("blueoak-1.0.0", "blue oak model licen[cs]e(?: 1 0 0)?", "blueoak 1 0 0"),
    ("bsd", "bsd(?: style)? licen[cs]e", ""),
    ("bsd-1-clause", "bsd 1 clause(?: licen[cs]e)?", "bsd 1 clause"),
    ("bsd-2-clause", "bsd 2 clause(?: licen[cs]e)?", "bsd 2 clause"),
    ("bsd-2-clause", "simplified bsd(?: licen[cs]e)?", "bsd 2 clause freebsd"),
    ("bsd-3-clause", "bsd 3 clause(?: licen[cs]e)?", "bsd 3 clause"),
    ("bsd-3-clause", "modified bsd(?: licen[cs]e)?", ""),
    ("bsd-3-clause-clear", "bsd 3 clause clear(?: licen[cs]e)?", "bsd 3 clause clear"),
    ("bsd-4-clause", "bsd 4 clause(?: licen[cs]e)?", "bsd 4 clause"),
    ("bsl-1.0", "boost software licen[cs]e(?: (?:version |v )?1(?: 0)?)?", "bsl 1 0"),
    ("busl-1.1", "business source licen[cs]e(?: 1 1)?", "busl 1 1"),
    ("bzip2-1.0.6", "bzip2 licen[cs]e", "bzip2 1 0 6"),
    ("cc-by-1.0", "cc by 1 0", "cc by 1 0"),
    ("cc-by-2.0", "cc by 2 0", "cc by 2 0"),
    ("cc-by-2.5", "cc by 2 5", "cc by 2 5"),
    ("cc-by-3.0", "cc by 3 0", "cc by 3 0"),
    ("cc-by-4.0", "cc by 4 0", "cc by 4 0"),
    ("cc-by-4.0", "creative commons attribution 4 0(?: international)?(?: licen[cs]e)?", ""),
    ("cc-by-nc", "cc by nc", ""),
    ("cc-by-nc-2.0", "cc by nc 2 0", "cc by nc 2 0"),
    ("cc-by-nc-3.0", "cc by nc 3 0", "cc by nc 3 0"),
    ("cc-by-nc-4.0", "cc by nc 4 0", "cc by nc 4 0"),
    ("cc-by-nc-4.0", "creative commons attribution non ?commercial 4 0(?: international)?(?: licen[cs]e)?", ""),
    ("cc-by-nc-nd-3.0", "cc by nc nd 3 0", "cc by nc nd 3 0"),
    ("cc-by-nc-nd-4.0", "cc by nc nd 4 0", "cc by nc nd 4 0"),
    ("cc-by-nc-sa-2.0", "cc by nc sa 2 0", "cc by nc sa 2 0"),
    ("cc-by-nc-sa-3.0", "cc by nc sa 3 0", "cc by nc sa 3 0"),
    ("cc-by-nc-sa-4.0", "cc by nc sa 4 0", "cc by nc sa 4 0"),
    ("cc-by-nd-3.0", "cc by nd 3 0", "cc by nd 3 0"),
    ("cc-by-nd-4.0", "cc by nd 4 0", "cc by nd 4 0"),
    ("cc-by-sa", "cc by sa", ""),
    ("cc-by-sa-2.0", "cc by sa 2 0", "cc by sa 2 0"),
    ("cc-by-sa-2.5", "cc by sa 2 5", "cc by sa 2 5"),
    ("cc-by-sa-3.0", "cc by sa 3 0", "cc by sa 3 0"),
    ("cc-by-sa-4.0", "cc by sa 4 0", "cc by sa 4 0"),
    ("cc-by-sa-4.0", "creative commons attribution share ?alike 4 0(?: international)?(?: licen[cs]e)?", ""),
    ("cc0-1.0", "cc0(?: 1 0)?(?: universal)?", "cc0 1 0"),
    ("cddl-1.0", "common development and distribution licen[cs]e(?: (?:version |v )?1(?: 0)?)?", "cddl 1 0"),
    ("cddl-1.1", "common development and distribution licen[cs]e (?:version |v )?1 1", "cddl 1 1"),
    ("cecill-2.1", "cecill(?: (?:version |v )?2 1)?(?: licen[cs]e)?", "cecill 2 1"),
    ("cpl-1.0", "common public licen[cs]e(?: (?:version |v )?1(?: 0)?)?", "cpl 1 0"),
    ("ecl-2.0", "educational community licen[cs]e(?: (?:version |v )?2(?: 0)?)?", "ecl 2 0"),
    ("elastic-2.0", "elastic licen[cs]e(?: (?:version |v )?2(?: 0)?)?", "elastic 2 0"),
    ("epl-1.0", "eclipse public licen[cs]e(?: (?:version |v )?1(?: 0)?)?", "epl 1 0"),
    ("epl-2.0", "eclipse public licen[cs]e (?:version |v )?2(?: 0)?", "epl 2 0"),
    ("eupl-1.2", "european union public licen[cs]e(?: (?:version |v )?1 2)?", "eupl 1 2"),
    ("gfdl-1.3", "gnu free documentation licen[cs]e(?: (?:version |v )?1 3)?", "gfdl 1 3"),
    ("gpl", "gnu general public licen[cs]e", ""),
    ("gpl-1.0", "gnu general public licen[cs]e (?:version |v )?1(?: 0)?", "gpl 1 0"),
    ("gpl-2.0", "gnu general public licen[cs]e (?:version |v )?2(?: 0)?", "gpl 2 0"),
    ("gpl-2.0", "gpl (?:version |v )?2(?: 0)?", "gpl 2 0 only"),
    ("gpl-2.0", "gplv2", ""),
    ("gpl-2.0-or-later", "gnu general public licen[cs]e (?:version |v )?2(?: 0)? or (?:any )?later", "gpl 2 0 or later"),
    ("gpl-3.0", "gnu general public licen[cs]e (?:version |v )?3(?: 0)?", "gpl 3 0"),
    ("gpl-3.0", "gpl (?:version |v )?3(?: 0)?", "gpl 3 0 only"),
    ("gpl-3.0", "gplv3", ""),
    ("gpl-3.0-or-later", "gnu general public licen[cs]e (?:version |v )?3(?: 0)? or (?:any )?later", "gpl 3 0 or later"),
    ("hpnd", "historical permission notice and disclaimer", "hpnd"),
    ("icu", "icu licen[cs]e", "icu"),
    ("ijg", "independent jpeg group licen[cs]e", "ijg"),
    ("ipl-1.0", "ibm public licen[cs]e(?: (?:version |v )?1(?: 0)?)?", "ipl 1 0"),
    ("isc", "isc licen[cs]e", "isc"),
    ("lgpl", "gnu (?:lesser|library) general public licen[cs]e", ""),
    ("lgpl-2.0", "gnu (?:lesser|library) general public licen[cs]e (?:version |v )?2(?: 0)?", "lgpl 2 0"),
    ("lgpl-2.1", "gnu (?:lesser|library) general public licen[cs]e (?:version |v )?2 1", "lgpl 2 1"),
    ("lgpl-2.1-or-later", "gnu (?:lesser|library) general public licen[cs]e (?:version |v )?2 1 or (?:any )?later", "lgpl 2 1 or later"),
    ("lgpl-3.0", "gnu lesser general public licen[cs]e (?:version |v )?3(?: 0)?", "lgpl 3 0"),
    ("lgpl-3.0-or-later", "gnu lesser general public licen[cs]e (?:version |v )?3(?: 0)? or (?:any )?later", "lgpl 3 0 or later"),
    ("libpng", "libpng licen[cs]e", "libpng"),
    ("llama", "llama (?:[0-9] )?(?:[0-9] )?community licen[cs]e", ""),
    ("lppl-1.3c", "latex project public licen[cs]e(?: (?:version |v )?1 3c?)?", "lppl 1 3c"),
    ("mit", "mit licen[cs]e", "mit"),
    ("mit-0", "mit no attribution(?: licen[cs]e)?", "mit 0"),
    ("mpl", "mozilla public licen[cs]e", ""),
    ("mpl-1.1", "mozilla public licen[cs]e (?:version |v )?1 1", "mpl 1 1"),
    ("mpl-2.0", "mozilla public licen[cs]e (?:version |v )?2(?: 0)?", "mpl 2 0"),
    ("ms-pl", "microsoft public licen[cs]e", "ms pl"),
    ("ms-rl", "microsoft reciprocal licen[cs]e", "ms rl"),
    ("mulanpsl-2.0", "mulan permissive software licen[cs]e(?: (?:version |v )?2)?", "mulanpsl 2 0"),
    ("ncsa", "university of illinois ncsa open source licen[cs]e", "ncsa"),
    ("odbl-1.0", "open database licen[cs]e(?: (?:version |v )?1(?: 0)?)?", "odbl 1 0"),
    ("odc-by-1.0", "open data commons attribution licen[cs]e(?: (?:version |v )?1(?: 0)?)?", "odc by 1 0"),
    ("ofl-1.1", "sil open font licen[cs]e(?: (?:version |v )?1 1)?", "ofl 1 1"),
    ("ogl-uk-3.0", "open government licen[cs]e(?: (?:version |v )?3(?: 0)?)?", "ogl uk 3 0"),
    ("openrail", "open(?: and)? responsible ai licen[cs]e", ""),
    ("openssl", "openssl licen[cs]e", "openssl"),
    ("osl-3.0", "open software licen[cs]e(?: (?:version |v )?3(?: 0)?)?", "osl 3 0"),
    ("pddl-1.0", "public domain dedication and licen[cs]e", "pddl 1 0"),
    ("php-3.01", "php licen[cs]e(?: (?:version |v )?3 01)?", "php 3 01"),
    ("postgresql", "postgresql licen[cs]e", "postgresql"),
    ("psf-2.0", "python software foundation licen[cs]e(?: (?:version |v )?2(?: 0)?)?", "psf 2 0"),
    ("qpl-1.0", "q public licen[cs]e", "qpl 1 0"),
    ("ruby", "ruby licen[cs]e", "ruby"),
    ("sspl-1.0", "server side public licen[cs]e(?: (?:version |v )?1)?", "sspl 1 0"),
    ("unicode", "unicode licen[cs]e(?: (?:version |v )?3)?", "unicode 3 0"),
    ("unlicense", "unlicense", "unlicense"),
    ("upl-1.0", "universal permissive licen[cs]e(?: (?:version |v )?1(?: 0)?)?", "upl 1 0"),
    ("vim", "vim licen[cs]e", "vim"),
    ("w3c", "w3c software (?:notice and )?licen[cs]e", "w3c"),
    ("wtfpl", "wtfpl", "wtfpl"),
    ("x11", "x11 licen[cs]e", "x11"),
    ("zlib", "zlib licen[cs]e", "zlib"),
    ("zpl-2.1", "zope public licen[cs]e(?: (?:version |v )?2 1)?", "zpl 2 1"),
]

#: label, keyword, lead, pattern: addresses of licenses as words.
LINKS = [
    ("agpl-3.0", "agpl", 3, "gnu org licenses agpl(?: 3 0)?"),
    ("apache-2.0", "apache", 0, "apache org licenses license 2 0"),
    ("bsd-2-clause", "bsd", 3, "opensource org licenses bsd 2 clause"),
    ("bsd-3-clause", "bsd", 3, "opensource org licenses bsd 3 clause"),
    ("bsl-1.0", "boost", 0, "boost org license 1 0"),
    ("cc-by-3.0", "creativecommons", 0, "creativecommons org licenses by 3 0"),
    ("cc-by-4.0", "creativecommons", 0, "creativecommons org licenses by 4 0"),
    ("cc-by-nc-3.0", "creativecommons", 0, "creativecommons org licenses by nc 3 0"),
    ("cc-by-nc-4.0", "creativecommons", 0, "creativecommons org licenses by nc 4 0"),
    ("cc-by-nc-nd-4.0", "creativecommons", 0, "creativecommons org licenses by nc nd 4 0"),
    ("cc-by-nc-sa-4.0", "creativecommons", 0, "creativecommons org licenses by nc sa 4 0"),
    ("cc-by-nd-4.0", "creativecommons", 0, "creativecommons org licenses by nd 4 0"),
    ("cc-by-sa-3.0", "creativecommons", 0, "creativecommons org licenses by sa 3 0"),
    ("cc-by-sa-4.0", "creativecommons", 0, "creativecommons org licenses by sa 4 0"),
    ("cc0-1.0", "creativecommons", 0, "creativecommons org publicdomain zero 1 0"),
    ("epl-2.0", "eclipse", 0, "eclipse org legal epl (?:v20|2 0)"),
    ("gfdl-1.3", "fdl", 3, "gnu org licenses fdl(?: 1 3)?"),
    ("gpl-2.0", "gpl", 3, "gnu org licenses gpl 2 0"),
    ("gpl-2.0", "gpl", 5, "gnu org licenses old licenses gpl 2 0"),
    ("gpl-3.0", "gpl", 3, "gnu org licenses gpl 3 0"),
    ("lgpl-2.1", "lgpl", 3, "gnu org licenses lgpl 2 1"),
    ("lgpl-3.0", "lgpl", 3, "gnu org licenses lgpl 3 0"),
    ("mit", "mit", 3, "opensource org licenses mit"),
    ("mpl-2.0", "mozilla", 0, "mozilla org (?:en us )?mpl 2 0"),
    ("ofl-1.1", "sil", 1, "scripts sil org ofl"),
    ("unlicense", "unlicense", 0, "unlicense org"),
    ("wtfpl", "wtfpl", 0, "wtfpl net"),
]

#: label, keyword, lead, pattern: wording of the licenses themselves; up to six foreign words may stand in a gap.
_GAP = "(?:[^ ]+ ){0,6}?"
TEXTS = [
    ("agpl-3.0", "affero", 6, "under the terms of the gnu affero general public license as published by the free software foundation"),
    ("apache-2.0", "compliance", 8, "you may not use this file except in compliance with the license"),
    ("apache-2.0", "reproduction", 1, "use reproduction and distribution as defined by sections 1 through 9 of this document"),
    ("artistic-2.0", "verbatim", 0, "verbatim copies of the source form of the standard version of this package"),
    ("beerware", "beer", 10, "this stuff is worth it you can buy me a beer in return"),
    ("bsd", "redistribution", 0, f"redistribution and use {_GAP}in source and binary forms with or without modification are permitted"),
    ("bsd-2-clause", "redistributions", 0, "redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-3-clause", "neither", 0, f"neither the name of {_GAP}nor the names of its contributors may be used to endorse or promote products"),
    ("bsd-3-clause", "endorse", 0, "endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-4-clause", "advertising", 1, "all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("bsl-1.0", "machine", 0, "machine executable object code generated by a source language processor"),
    ("cc0-1.0", "waived", 0, "waived all copyright and related or neighboring rights to"),
    ("cddl-1.0", "cddl", 0, "cddl header start"),
    ("epl-1.0", "eclipse", 11, "this program and the accompanying materials are made available under the eclipse public license"),
    ("gfdl-1.3", "invariant", 1, "no invariant sections(?: no front cover texts)?(?: and no back cover texts)?"),
    ("gpl", "redistribute", 2, "you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl", "merchantability", 9, "without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("gpl-2.0-or-later", "later", 11, "either version 2 of the license or at your option any later version"),
    ("gpl-3.0-or-later", "later", 11, "either version 3 of the license or at your option any later version"),
    ("isc", "disclaims", 1, "author disclaims all warranties with regard to this software"),
    ("isc", "permission", 0, "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("lgpl", "redistribute", 2, "you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license"),
    ("mit", "hereby", 2, "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", "sublicense", 6, "use copy modify merge publish distribute sublicense and or sell copies"),
    ("mit", "substantial", 8, "notice shall be included in all copies or substantial portions of the software"),
    ("mpl-1.1", "contents", 1, "the contents of this file are subject to the mozilla public license version 1 1"),
    ("mpl-2.0", "mozilla", 11, "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("ncsa", "disclaimers", 0, "disclaimers in the documentation and or other materials provided with the distribution"),
    ("ofl-1.1", "font", 1, "this font software is licensed under the sil open font license(?: version 1 1)?"),
    ("openssl", "openssl", 3, "developed by the openssl project for use in the openssl toolkit"),
    ("proprietary", "confidential", 1, "strictly confidential(?: and proprietary)?"),
    ("proprietary", "proprietary", 0, "proprietary and confidential"),
    ("proprietary", "unauthorized", 0, "unauthorized (?:copying|use|distribution|reproduction) of this (?:file|software|document|work)"),
    ("public-domain", "domain", 4, "(?:released|placed|dedicated) (?:in|into|to) the public domain"),
    ("public-domain", "unencumbered", 4, "this is free and unencumbered software released into the public domain"),
    ("unlicense", "unencumbered", 4, "this is free and unencumbered software"),
    ("wtfpl", "wtfpl", 0, "wtfpl version 2"),
    ("x11", "consortium", 5, "the name of the x consortium shall not be used in advertising"),
    ("zlib", "misrepresented", 8, "the origin of this software must not be misrepresented"),
    ("zlib", "altered", 0, "altered source versions must be plainly marked as such"),
]

#: label, keyword, lead, pattern: words that only tell that there are terms.
GENERICS = [
    ("copyright", "copyright", 0, "copyright (?:c )?(?:©)?(?:19|20)[0-9][0-9]"),
    ("licensed", "under", 1, "licen[cs]ed under"),
    ("licensed", "spdx", 0, "spdx license identifier"),
    ("non-commercial", "commercial", 1, "non commercial use only"),
    ("non-commercial", "noncommercial", 0, "noncommercial use only"),
    ("no-derivatives", "derivatives", 1, "no derivatives"),
    ("terms", "terms", 0, "terms (?:of use|of service|and conditions) apply"),
]

#: Fixed by the contract of the scan: phrases and their labels.
BASE = [("cc-by", "cc", 0, "cc by"), ("gpl", "general", 0, "general public license"), ("reserved", "reserved", 2, "all rights reserved")]


def rules() -> list[Rule]:
    """All rules in order; of equal priority and span the first wins."""
    out: list[Rule] = []

    def add(label: str, keyword: str, lead: int, pattern: str, priority: int, needs: tuple[str, ...] = (), base: bool = False) -> None:
        out.append(Rule(len(out), keyword, lead, needs, pattern, label, priority, base))

    first = {name: re.match("[a-z0-9]+", name).group() for _, name, _ in NAMES}
    for text in TEXTS:
        add(*text, TEXT)
    for label, _, tag in NAMES:
        if tag:
            add(label, "spdx", 0, f"spdx license identifier {tag}", TAG)
    for label, name, _ in NAMES:
        add(label, "under", 1, f"(?:licen[cs]ed|released|distributed|available|published|covered) under (?:the )?(?:terms of (?:the )?)?{name}", NOTICE, (first[name],))
    for link in LINKS:
        add(*link, LINK)
    for label, name, _ in NAMES:
        add(label, first[name], 0, name, NAME)
    for generic in GENERICS:
        add(*generic, GENERIC)
    for phrase in BASE:
        add(*phrase, GENERIC, base=True)
    return out
