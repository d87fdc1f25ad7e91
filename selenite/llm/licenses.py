"""Licence scans by ordered signature rules, with DataFrame functions only.

A text is normalised to its words (A-Z lowered, joined by one blank). A rule is a
regular expression over that string with keywords, a label and a priority. A
text without any trigger is never normalised; of the others, only the rules with
a keyword among the words are run. Tags with SPDX ids are read by an expression of their own,
operand by operand, so ``Apache-2.0 OR MIT`` gives both. A detection is dropped where another of
higher priority covers its interval, or one of the same priority that is longer
or, on the same interval, stands earlier in the table. What survives
gives the labels and the score.

Everything happens inside the row, so nothing is shuffled, whatever the sources or
copies. Positions are summed in blocks, and detections are folded in order, so
the cost follows the text's length.

Defined results: null and empty texts have no words and no labels, and score 0;
equal rows get equal results; ids and other columns are not read; an empty table
gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
LICENCE = "licen[cs]e"

#: Fixed values, hand-written: label, keywords (every match holds one of them), name as a regular expression over words.
FAMILIES = [
    ("mit", "mit", f"mit(?: x11)? {LICENCE}"),
    ("mit-0", "mit", f"mit no attribution(?: {LICENCE})?"),
    ("x11", "x11", f"x11 {LICENCE}"),
    ("apache-1.0", "apache", f"apache(?: software)? {LICENCE}(?: version)? (?:v ?)?1 0"),
    ("apache-1.1", "apache", f"apache(?: software)? {LICENCE}(?: version)? (?:v ?)?1 1"),
    ("apache-2.0", "apache", f"apache(?: software)? {LICENCE}(?: version)? (?:v ?)?2(?: 0)?"),
    ("apache", "apache", f"apache(?: software)? {LICENCE}"),
    ("isc", "isc", f"isc {LICENCE}"),
    ("zlib", "zlib", f"zlib(?: libpng)? {LICENCE}"),
    ("libpng", "libpng", f"libpng {LICENCE}"),
    ("unlicense", "unlicense", "(?:the )?unlicense"),
    ("wtfpl", "wtfpl", f"wtfpl(?: public {LICENCE})?"),
    ("bsl-1.0", "boost", f"boost software {LICENCE}(?: version)?(?: 1 0)?"),
    ("busl-1.1", "business", f"business source {LICENCE}(?: version)?(?: 1 1)?"),
    ("postgresql", "postgresql", f"postgresql {LICENCE}"),
    ("openssl", "openssl", f"openssl {LICENCE}"),
    ("php-3.0", "php", f"php {LICENCE}(?: version)? 3 0"),
    ("php-3.01", "php", f"php {LICENCE}(?: version)? 3 01"),
    ("psf-2.0", "python", f"python software foundation {LICENCE}(?: version)?(?: 2)?"),
    ("ruby", "ruby", f"ruby {LICENCE}"),
    ("ms-pl", "microsoft", f"microsoft public {LICENCE}"),
    ("ms-rl", "microsoft", f"microsoft reciprocal {LICENCE}"),
    ("ofl-1.1", "ofl", "sil ofl(?: 1 1)?"),
    ("ofl-1.1", "font", f"(?:sil )?open font {LICENCE}(?: version)?(?: 1 1)?"),
    ("odbl-1.0", "database", f"open database {LICENCE}(?: v1 0)?"),
    ("odc-by-1.0", "attribution", f"open data commons attribution {LICENCE}"),
    ("pddl-1.0", "public", f"(?:open data commons )?public domain dedication and {LICENCE}"),
    ("public-domain", "domain", "(?:in|to|into) the public domain"),
    ("public-domain", "dedicated", "dedicated to the public(?: domain)?"),
    ("cc0-1.0", "cc0", "cc0(?: 1 0)?(?: universal)?"),
    ("cc0-1.0", "commons", "creative commons (?:zero|cc0)(?: 1 0)?"),
    ("json", "json", f"json {LICENCE}"),
    ("ncsa", "ncsa", f"ncsa(?: open source)? {LICENCE}"),
    ("vim", "vim", f"vim {LICENCE}"),
    ("hpnd", "historical", "historical permission notice and disclaimer"),
    ("ijg", "jpeg", f"independent jpeg group {LICENCE}"),
    ("curl", "curl", f"curl {LICENCE}"),
    ("bzip2", "bzip2", f"bzip2(?: and libbzip2)? {LICENCE}"),
    ("w3c", "w3c", f"w3c(?: software)?(?: notice and)? {LICENCE}"),
    ("unicode", "unicode", f"unicode {LICENCE}"),
    ("sleepycat", "sleepycat", f"sleepycat {LICENCE}"),
    ("qpl-1.0", "public", f"q public {LICENCE}(?: 1 0)?"),
    ("nasa-1.3", "nasa", "nasa open source agreement(?: 1 3)?"),
    ("ipa", "ipa", f"ipa font {LICENCE}"),
    ("intel", "intel", f"intel open source {LICENCE}"),
    ("beerware", "beer beerware", f"(?:the )?beer ?ware {LICENCE}"),
    ("ecl-2.0", "educational", f"educational community {LICENCE}(?: version)?(?: 2 0)?"),
    ("cpal-1.0", "attribution", f"common public attribution {LICENCE}(?: 1 0)?"),
    ("cpl-1.0", "common", f"common public {LICENCE}(?: 1 0)?"),
    ("ipl-1.0", "ibm", f"ibm public {LICENCE}(?: 1 0)?"),
    ("upl-1.0", "universal", f"universal permissive {LICENCE}"),
    ("sspl-1.0", "server", f"server side public {LICENCE}"),
    ("elastic-2.0", "elastic", f"elastic {LICENCE}(?: 2 0)?"),
    ("blueoak-1.0.0", "oak", f"blue oak model {LICENCE}"),
    ("mulan-psl-2.0", "mulan", f"mulan(?: permissive software)? {LICENCE}(?: v2)?"),
    ("gpl", "gnu", f"gnu general public {LICENCE}"),
    ("lgpl", "lesser library", f"(?:gnu )?(?:lesser|library) general public {LICENCE}"),
    ("agpl", "affero", f"(?:gnu )?affero general public {LICENCE}"),
    ("gfdl", "documentation", f"(?:gnu )?free documentation {LICENCE}"),
    ("cc", "commons", f"creative commons(?: {LICENCE})?"),
]
#: Wordings of license texts and headers: label, keywords (every match holds one of them), expression.
WORDINGS = [
    ("mit", "permission", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "permission", "the above copyright notice and this permission notice (?:including the next paragraph )?shall be included in all copies or substantial portions of the software"),
    ("x11", "consortium", "the name of the x consortium shall not be used in advertising"),
    ("x11", "advertising", "shall not be used in advertising or otherwise to promote the sale use or other dealings in this software"),
    ("bsd", "redistribution", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "redistributions", "redistributions of source code must retain the above copyright notice"),
    ("bsd", "redistributions", "redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-3-clause", "endorse", "may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-4-clause", "advertising", "all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("bsd-3-clause-clear", "express", "no express or implied licenses to any party s patent rights are granted"),
    ("isc", "permission", "permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted"),
    ("hpnd", "permission", "permission to use copy modify (?:and )?distribute (?:and sell )?this software and its documentation for any purpose"),
    ("0bsd", "permission", "permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted the software is provided"),
    ("apache-2.0", "apache", f"you may not use this file except in compliance with the {LICENCE} you may obtain a copy of the {LICENCE} at http(?:s)? www apache org licenses license 2 0"),
    ("apache-2.0", "apache", "http(?:s)? www apache org licenses license 2 0"),
    ("apache-2.0", "contributor", f"each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright {LICENCE}"),
    ("apache-1.1", "apache", "this product includes software developed by the apache software foundation"),
    ("zlib", "warranty", "this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("zlib", "altered", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software redistribution"),
    ("bsl-1.0", "permission", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software"),
    ("unlicense", "unencumbered", "this is free and unencumbered software released into the public domain"),
    ("wtfpl", "copying", "terms and conditions for copying distribution and modification 0 you just do what the fuck you want to public license"),
    ("gpl", "software", f"this program is free software you can redistribute it and or modify it under the terms of the gnu general public {LICENCE}"),
    ("gpl", "gnu", f"you should have received a copy of the gnu general public {LICENCE}"),
    ("lgpl", "gnu", f"you should have received a copy of the gnu (?:lesser|library) general public {LICENCE}"),
    ("agpl", "gnu", f"you should have received a copy of the gnu affero general public {LICENCE}"),
    ("gpl-classpath-exception", "classpath", "(?:with the )?classpath exception"),
    ("gpl-linking-exception", "exception", "as a special exception the copyright holders (?:of this library )?give you permission to link this library"),
    ("gcc-exception", "gcc", "gcc runtime library exception"),
    ("gfdl", "document", f"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation {LICENCE}"),
    ("mpl-1.1", "mozilla", f"the contents of this file are subject to the mozilla public {LICENCE} version 1 1"),
    ("mpl-2.0", "mozilla", f"this source code form is subject to the terms of the mozilla public {LICENCE} v 2 0"),
    ("mpl-2.0-no-copyleft", "incompatible", "this source code form is incompatible with secondary licenses"),
    ("epl", "eclipse", f"this program and the accompanying materials are made available under the terms of the eclipse public {LICENCE}"),
    ("cddl", "cddl", "the contents of this file are subject to the terms of the common development and distribution license cddl"),
    ("ofl-1.1", "font", f"this font software is licensed under the sil open font {LICENCE}"),
    ("ofl-1.1", "font", "the font software may be sold as part of a larger software package but no copy of one or more of the font software typefaces may be sold by itself license"),
    ("cc0-1.0", "waived", "to the extent possible under law .{1,60} (?:has|have) waived all copyright and related or neighboring rights"),
    ("cc", "commons", f"this work is licensed under (?:a|the) creative commons .{{1,80}} {LICENCE}"),
    ("public-domain", "domain", "(?:this (?:file|work|code|software) is|has been placed|i hereby place it) (?:in|into) the public domain"),
    ("no-copyright", "copyright", "the author disclaims copyright to this source code"),
    ("postgresql", "agreement", "without a written agreement is hereby granted provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies"),
    ("ncsa", "license", "permission is hereby granted free of charge .{1,80} to deal with the software without restriction .{1,400} ncsa open source license"),
    ("python-2.0", "python", f"this {LICENCE} agreement is between the python software foundation"),
    ("openssl", "openssl", "this product includes software developed by the openssl project for use in the openssl toolkit copyright"),
    ("w3c", "w3c", "by obtaining(?: using and or copying)? this work you the licensee agree that you have read understood and will comply with .{1,80} w3c"),
    ("ms-pl", "microsoft", f"this {LICENCE} governs use of the accompanying software .{{1,200}} microsoft public {LICENCE}"),
    ("artistic", "perl", "this (?:library|program) is free software you (?:can|may) redistribute it and or modify it under the same terms as perl(?: itself)? license"),
    ("unicode", "unicode", f"unicode inc {LICENCE} agreement data files and software"),
    ("commons-clause", "clause", f"commons clause {LICENCE} condition"),
    ("non-commercial", "commercial noncommercial", f"licensed? for non ?commercial (?:use|purposes) only"),
    ("redistributable", "copies", "permission is granted to make and distribute verbatim copies of this (?:manual|document|license)"),
]
#: Ids of the SPDX list.
SPDX_IDS = """
0BSD AFL-1.1 AFL-1.2 AFL-2.0 AFL-2.1 AFL-3.0 AGPL-1.0-only AGPL-1.0-or-later AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-1.0 Apache-1.1
Apache-2.0 APSL-1.0 APSL-1.1 APSL-1.2 APSL-2.0 Artistic-1.0 Artistic-1.0-Perl Artistic-2.0 Beerware BlueOak-1.0.0 BSD-1-Clause BSD-2-Clause
BSD-2-Clause-Patent BSD-2-Clause-Views BSD-3-Clause BSD-3-Clause-Attribution BSD-3-Clause-Clear BSD-3-Clause-LBNL BSD-4-Clause BSD-4-Clause-UC
BSD-Protection BSD-Source-Code BSL-1.0 BUSL-1.1 bzip2-1.0.6 CAL-1.0 CC-BY-1.0 CC-BY-2.0 CC-BY-2.5 CC-BY-3.0 CC-BY-4.0 CC-BY-NC-1.0 CC-BY-NC-2.0
CC-BY-NC-2.5 CC-BY-NC-3.0 CC-BY-NC-4.0 CC-BY-NC-ND-4.0 CC-BY-NC-SA-3.0 CC-BY-NC-SA-4.0 CC-BY-ND-3.0 CC-BY-ND-4.0 CC-BY-SA-2.0 CC-BY-SA-2.5
CC-BY-SA-3.0 CC-BY-SA-4.0 CC-PDDC CC0-1.0 CDDL-1.0 CDDL-1.1 CDLA-Permissive-1.0 CDLA-Permissive-2.0 CDLA-Sharing-1.0 CECILL-1.0 CECILL-1.1
CECILL-2.0 CECILL-2.1 CECILL-B CECILL-C CERN-OHL-P-2.0 CERN-OHL-S-2.0 CERN-OHL-W-2.0 CPAL-1.0 CPL-1.0 curl ECL-1.0 ECL-2.0 EFL-1.0 EFL-2.0
Elastic-2.0 EPL-1.0 EPL-2.0 EUPL-1.0 EUPL-1.1 EUPL-1.2 FSFAP FTL GFDL-1.1-only GFDL-1.1-or-later GFDL-1.2-only GFDL-1.2-or-later GFDL-1.3-only
GFDL-1.3-or-later GPL-1.0-only GPL-1.0-or-later GPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0 GPL-3.0-only GPL-3.0-or-later HPND ICU IJG
ImageMagick Info-ZIP Intel IPA IPL-1.0 ISC JSON LGPL-2.0-only LGPL-2.0-or-later LGPL-2.1 LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0 LGPL-3.0-only
LGPL-3.0-or-later Libpng libtiff LPL-1.02 LPPL-1.0 LPPL-1.1 LPPL-1.2 LPPL-1.3a LPPL-1.3c MIT MIT-0 MIT-CMU MIT-Modern-Variant MPL-1.0 MPL-1.1
MPL-2.0 MPL-2.0-no-copyleft-exception MS-PL MS-RL MulanPSL-1.0 MulanPSL-2.0 NASA-1.3 NCSA Net-SNMP NPL-1.0 NPL-1.1 NTP ODbL-1.0 ODC-By-1.0
OFL-1.0 OFL-1.1 OLDAP-2.8 OpenSSL OSL-1.0 OSL-2.0 OSL-2.1 OSL-3.0 PDDL-1.0 PHP-3.0 PHP-3.01 PostgreSQL PSF-2.0 Python-2.0 QPL-1.0 Ruby Sleepycat
SSPL-1.0 TCL Unicode-3.0 Unicode-DFS-2016 Unlicense UPL-1.0 Vim W3C WTFPL X11 Zlib zlib-acknowledgement ZPL-2.0 ZPL-2.1
Classpath-exception-2.0 GCC-exception-3.1 LLVM-exception
""".split()
#: Forms of a name that carry terms; with the priority of what they find.
GRANT = (
    "(?:licen[cs]ed|released|distributed|published|provided|offered|available|redistributed|covered) (?:under|by)"
    "(?: the)?(?: terms)?(?: and conditions)?(?: of)?(?: the)? "
)
#: Signs of rights without a named licence: label, keywords, expression, priority.
NOTICES = [
    ("all-rights-reserved", "reserved", "(?:all|some) rights (?:are )?reserved", 1),
    ("copyright", "copyright", "copyright(?: c)?(?: (?:19|20)[0-9]{2})", 1),
    ("proprietary", "proprietary", f"(?:proprietary and confidential|proprietary {LICENCE})", 2),
    ("no-redistribution", "redistribution", "redistribution (?:is )?(?:prohibited|not permitted|forbidden)", 2),
    ("eula", "user", f"end user {LICENCE} agreement", 2),
    ("as-is", "warranty warranties", "as is without (?:any )?warrant(?:y|ies)", 1),
]
#: Fixed values, hand-written: short spellings with a version, as ids have them outside of tags: label, keywords, expression.
SHORT = [
    ("apache-1.1", "apache", "apache 1 1"),
    ("apache-2.0", "apache", "apache(?: v)? 2 0"),
    ("apache-2.0", "apache2 apachev2", "apachev?2(?: 0)?"),
    ("apache-2.0", "asl", "asl (?:v?2 0|v2)"),
    ("mpl-1.1", "mpl", "mpl(?: version)? v?1 1"),
    ("mpl-2.0", "mpl", "mpl(?: version)? (?:v?2 0|v2)"),
    ("mpl-2.0", "mplv2 mpl2", "mplv?2(?: 0)?"),
    ("epl-1.0", "epl", "epl(?: version)? (?:v?1 0|v1)"),
    ("epl-2.0", "epl", "epl(?: version)? (?:v?2 0|v2)"),
    ("epl-2.0", "eplv2 epl2", "eplv?2(?: 0)?"),
    ("eupl-1.2", "eupl", "eupl(?: version)? v?1 2"),
    ("eupl-1.1", "eupl", "eupl(?: version)? v?1 1"),
    ("lppl-1.3", "lppl", "lppl(?: version)? v?1 3[ac]?"),
    ("bsl-1.0", "bsl", "bsl 1 0"),
    ("busl-1.1", "busl", "busl 1 1"),
    ("upl-1.0", "upl", "upl 1 0"),
    ("ecl-2.0", "ecl", "ecl 2 0"),
    ("afl-3.0", "afl", "afl 3 0"),
    ("osl-3.0", "osl", "osl 3 0"),
    ("ofl-1.1", "ofl", "ofl 1 1"),
    ("odbl-1.0", "odbl", "odbl v?1 0"),
    ("sspl-1.0", "sspl", "sspl v?1(?: 0)?"),
    ("gpl-1", "gplv1", "gplv1"),
    ("gpl-2", "gplv2 gpl2", "(?:gnu )?gplv?2(?: 0)?(?: only)?"),
    ("gpl-3", "gplv3 gpl3", "(?:gnu )?gplv?3(?: 0)?(?: only)?"),
    ("gpl-2-or-later", "gplv2 gpl2", "(?:gnu )?gplv?2(?: 0)? or(?: any)? later(?: version)?"),
    ("gpl-3-or-later", "gplv3 gpl3", "(?:gnu )?gplv?3(?: 0)? or(?: any)? later(?: version)?"),
    ("lgpl-2", "lgplv2 lgpl2", "(?:gnu )?lgplv?2(?: 0)?"),
    ("lgpl-2.1", "lgplv2 lgpl2", "(?:gnu )?lgplv?2 1(?: only)?"),
    ("lgpl-3", "lgplv3 lgpl3", "(?:gnu )?lgplv?3(?: 0)?(?: only)?"),
    ("lgpl-2.1-or-later", "lgplv2 lgpl2", "(?:gnu )?lgplv?2 1 or(?: any)? later(?: version)?"),
    ("lgpl-3-or-later", "lgplv3 lgpl3", "(?:gnu )?lgplv?3(?: 0)? or(?: any)? later(?: version)?"),
    ("agpl-3", "agplv3 agpl3", "(?:gnu )?agplv?3(?: 0)?(?: only)?"),
    ("agpl-3-or-later", "agplv3 agpl3", "(?:gnu )?agplv?3(?: 0)? or(?: any)? later(?: version)?"),
    ("gfdl-1.3", "gfdl", "gfdl 1 3"),
]
#: Fixed values, hand-written: names so short that they count behind a grant only (``under MIT``): label, keywords, expression.
GRANTED = [
    ("mit", "mit", "mit(?: x11)?"),
    ("apache-2.0", "apache", "apache(?: version)? v?2(?: 0)?"),
    ("apache", "apache", "apache"),
    ("bsd", "bsd", "bsd"),
    ("isc", "isc", "isc"),
    ("zlib", "zlib", "zlib"),
    ("gpl", "gpl", "(?:gnu )?gpl"),
    ("lgpl", "lgpl", "(?:gnu )?lgpl"),
    ("agpl", "agpl", "(?:gnu )?agpl"),
    ("mpl", "mpl", "mpl"),
    ("epl", "epl", "epl"),
    ("cddl", "cddl", "cddl"),
    ("artistic", "artistic", "artistic"),
    ("wtfpl", "wtfpl", "wtfpl"),
]
UNDER = "(?:licen[cs]ed|released|distributed|published|provided|offered|available|redistributed|covered|made available|licen[cs]e is|dual licen[cs]ed) (?:under|by)(?: the)?(?: terms of)?(?: the)? "
WEIGHTS = {1: 0.5, 2: 0.7, 3: 0.9, 4: 1.0}
BASE_WEIGHT = 0.4
MAX_BLOCK = 256

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ANY_CASE_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
NO_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
#: A plus sign behind a version: "or later".
PLUS = r"(?<=[0-9])\+(?![0-9+])"
#: Every match of every rule and base phrase holds a trigger.
TRIGGER = rf"(?i)licen[cs]|gpl|permission|redistributions|advertising{NO_WORD}+materials|advertising{NO_WORD}+or|(?:promote|endorse){NO_WORD}|classpath|gcc{NO_WORD}+runtime|consortium|unencumbered|apache|bsd|cddl|cecill|as{NO_WORD}+is{NO_WORD}+without|copyright|reserved|spdx|proprietary|redistribution|warranties|public{NO_WORD}+domain|dedicated|cc0|wtfpl|cc{NO_WORD}+by|historical{NO_WORD}+permission|nasa{NO_WORD}+open|sil{NO_WORD}+ofl|creative{NO_WORD}+commons|mit{NO_WORD}+no|{NO_WORD}(?:asl|mpl|epl|eupl|lppl|bsl|busl|upl|ecl|afl|osl|ofl|odbl|sspl|gfdl)v?(?:{NO_WORD}|[0-9])|^(?:asl|mpl|epl|eupl|lppl|bsl|busl|upl|ecl|afl|osl|ofl|odbl|sspl|gfdl)v?(?:{NO_WORD}|[0-9])|(?:under|by){NO_WORD}+(?:the{NO_WORD}+)?(?:terms{NO_WORD}+)?(?:of{NO_WORD}+)?(?:the{NO_WORD}+)?(?:mit|isc|mpl|epl)|zlib|artistic"


#: The versions that exist.
GNU_VERSIONS = {"gpl": {"1", "2", "3"}, "lgpl": {"2", "2 1", "3"}, "agpl": {"1", "3"}}
PRODUCTS = [
    ("mpl", "mozilla", f"mozilla public {LICENCE}", "1.0 1.1 2.0"),
    ("epl", "eclipse", f"eclipse public {LICENCE}", "1.0 2.0"),
    ("eupl", "european", f"european union public {LICENCE}", "1.0 1.1 1.2"),
    ("cddl", "cddl", f"(?:common development and distribution {LICENCE} )?cddl", "1.0 1.1"),
    ("osl", "open", f"open software {LICENCE}", "1.0 1.1 2.0 2.1 3.0"),
    ("afl", "academic", f"academic free {LICENCE}", "1.1 1.2 2.0 2.1 3.0"),
    ("artistic", "artistic", f"artistic {LICENCE}", "1.0 2.0"),
    ("lppl", "latex", f"latex project public {LICENCE}", "1.0 1.1 1.2 1.3"),
    ("cecill", "cecill", "cecill(?: free software licen[cs]e)?", "1.0 1.1 2.0 2.1"),
    ("apsl", "apple", f"apple public source {LICENCE}", "1.0 1.1 1.2 2.0"),
    ("gfdl", "documentation", f"(?:gnu )?free documentation {LICENCE}", "1.1 1.2 1.3"),
]


def tag_words(spdx_id: str) -> str:
    return spdx_id.lower().replace("-", " ").replace(".", " ")


def tag_label(spdx_id: str) -> str:
    """An id's label: the id in small letters; of the GNU licenses as their names give it."""
    label = spdx_id.lower()
    return label.replace(".0", "", 1) if label.startswith(("gpl-", "lgpl-", "agpl-")) else label


def versions() -> list[tuple[str, str, str]]:
    """The families whose members follow a rule: name x version (x terms)."""
    out = []
    for terms, v in product(["by", "by sa", "by nc", "by nd", "by nc sa", "by nc nd"], ["1 0", "2 0", "2 5", "3 0", "4 0"]):
        label = f"cc-{terms.replace(' ', '-')}-{v.replace(' ', '.')}"
        out.append((label, "cc", f"cc {terms} {v}"))
        long = {"by": "attribution", "sa": "share ?alike", "nc": "non ?commercial", "nd": "no ?deriv(?:ative)?s?(?: works)?"}
        name = " ".join(long[t] for t in terms.split())
        out.append((label, "commons", f"creative commons {name}(?: {v.split()[0]} {v.split()[1]})(?: international| unported| generic)?"))
    for (label, key, name), v in product(
        [("gpl", "gpl general", f"(?:gpl|gnu gpl|gnu general public {LICENCE})"), ("lgpl", "lgpl", "(?:gnu )?lgpl"), ("agpl", "agpl", "(?:gnu )?agpl")],
        ["1", "2", "2 1", "3"],
    ):
        if v not in GNU_VERSIONS[label]:
            continue
        out.append((f"{label}-{v.replace(' ', '.')}", key, f"{name}(?: version)? v?{v}(?: 0)?"))
        out.append((f"{label}-{v.replace(' ', '.')}-only", key, f"{name}(?: version)? v?{v}(?: 0)? only"))
        out.append((f"{label}-{v.replace(' ', '.')}-or-later", key, f"{name}(?: version)? v?{v}(?: 0)? or(?: \\(?at your option\\)?)?(?: any)? later(?: version)?"))
    for (label, key, kind), v in product(
        [("gpl", "general", "general"), ("lgpl", "lesser", "lesser general"), ("agpl", "affero", "affero general")], ["1", "2", "2 1", "3"]
    ):
        if v not in GNU_VERSIONS[label]:
            continue
        name = f"(?:gnu )?{kind} public {LICENCE}(?: version)? v?{v}(?: 0)?"
        out.append((f"{label}-{v.replace(' ', '.')}-only", key, f"{name} only"))
        out.append((f"{label}-{v.replace(' ', '.')}", key, name))
        out.append((f"{label}-{v.replace(' ', '.')}-or-later", key, f"{name} or(?: any)? later(?: version)?"))
    for n, word in ((0, "zero"), (1, "one"), (2, "two"), (3, "three"), (4, "four")):
        out.append((f"bsd-{n}-clause", "bsd", f"(?:bsd (?:{n}|{word}) clause|(?:{n}|{word}) clause bsd)(?: {LICENCE})?"))
    out.append(("bsd", "bsd", f"(?:new |modified |simplified |revised )?bsd(?: style)? {LICENCE}"))
    for label, key, name, known in PRODUCTS:
        for v in ["", *known.split()]:
            spaced = v.replace(".", " ")
            out.append((f"{label}-{v}".rstrip("-"), key, name + (f"(?: version)? v?{spaced}" if v else "")))
    return out


def rules() -> list[tuple[int, str, str, str, int]]:
    """(order, keywords, expression, label, priority): every name and the grants of it, wordings, notices."""
    out = []
    for label, key, name in [*FAMILIES, *versions()]:
        out.append((key, f"(?<= ){name}(?= )", label, 2))
        out.append((key, f"(?<= ){GRANT}(?:an? )?(?:{name})(?= )", label, 3))
    out += [(key, f"(?<= ){e}(?= )", label, 2) for label, key, e in SHORT]
    out += [(key, f"(?<= ){UNDER}{e}(?= )", label, 3) for label, key, e in GRANTED]
    out += [(key, f"(?<= ){e}(?= )", label, 3) for label, key, e in WORDINGS]
    out += [(key, f"(?<= ){e}(?= )", label, p) for label, key, e, p in NOTICES]
    return [(i, *r) for i, r in enumerate(out)]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.transform(F.array(value), body)[0]


def lower_ascii(text: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def running_sums(numbers: Column) -> Column:
    """Sums of the numbers up to each place, by blocks."""
    total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)

    def whole(a: Column) -> Column:
        blocks = F.transform(
            F.sequence(F.lit(0), F.floor((F.size(a) - 1) / MAX_BLOCK).cast("int")),
            lambda b: F.slice(a, b * MAX_BLOCK + 1, F.lit(MAX_BLOCK)),
        )
        return let(blocks, lambda bs: let(
            F.aggregate(bs, F.array(F.lit(0)), lambda s, b: F.array_append(s, F.element_at(s, -1) + total(b))),
            lambda offsets: F.flatten(F.transform(bs, lambda b, k: F.transform(
                b, lambda _, i: offsets[k] + total(F.slice(b, F.lit(1), i + 1))))),
        ))

    return F.when(F.size(numbers) > 0, whole(numbers)).otherwise(F.array().cast("array<int>"))


def rule_table() -> Column:
    """The rules as an array literal of structs."""
    rows = [
        F.struct(F.lit(o).alias("o"), F.array(*map(F.lit, k.split())).alias("k"), F.lit(e).alias("e"), F.lit(x).alias("x"), F.lit(p).alias("p"))
        for o, k, e, x, p in rules()
    ]
    return F.array(*rows)


def matches(norm: Column, expression: Column, of: Callable[[Column, Column], Column]) -> Column:
    """``of`` the end and the text of every match, as an array."""
    pair = F.struct(
        F.regexp_extract_all(norm, expression, F.lit(0)).alias("m"),
        F.transform(F.split(norm, expression, -1), F.length).alias("s"),
    )
    return let(pair, lambda x: let(
        running_sums(F.zip_with(x["m"], F.slice(x["s"], F.lit(1), F.size(x["m"])), lambda m, s: F.length(m) + s)),
        lambda ends: F.zip_with(ends, x["m"], of),
    ))


def detection(end: Column, size: Column, order: Column, priority: Column, label: Column) -> Column:
    return F.struct((end - size).alias("start"), (-end).alias("back"), (-priority).alias("down"), order.alias("o"), label.alias("x"))


def tags(norm: Column) -> Column:
    """A detection for each operand of each tag; the first holds the tag's opening words."""
    ids = sorted(map(tag_words, SPDX_IDS), key=lambda x: (-len(x), x))
    one = f"(?:{'|'.join(ids)})"
    opening = f"spdx {LICENCE} identifier "
    expression = F.lit(f"(?<= ){opening}{one}(?= )(?: (?:or|and|with) {one}(?= ))*")
    table = F.create_map(*(F.lit(x) for i in SPDX_IDS for x in (tag_words(i), tag_label(i))))
    between = " (?:or|and|with) (?!later )(?!later$)"

    def operands(end: Column, text: Column) -> Column:
        parts, joins = F.split(text, between, -1), F.regexp_extract_all(text, F.lit(between), F.lit(0))
        return let(F.struct(parts.alias("p"), F.array_append(F.transform(joins, F.length), F.lit(0)).alias("j")), lambda x: let(
            running_sums(F.zip_with(x["p"], x["j"], lambda p, j: F.length(p) + j)),
            lambda sums: F.transform(x["p"], lambda p, i: detection(
                end - F.length(text) + sums[i] - x["j"][i], F.length(p), F.lit(-1), F.lit(4), F.element_at(table, F.regexp_replace(p, F.lit("^" + opening), F.lit("")))))))

    return F.flatten(matches(norm, expression, operands))


def detections(norm: Column, words: Column) -> Column:
    """All matches of the rules with a keyword among the words, sorted: wider, higher, earlier first."""

    def of(rule: Column) -> Column:
        return matches(norm, rule["e"], lambda end, m: detection(end, F.length(m), rule["o"], rule["p"], rule["x"]))

    keys = sorted({k for r in rules() for k in r[1].split()})
    own = F.array_intersect(words, F.array(*map(F.lit, keys)))
    plain = let(own, lambda k: F.flatten(F.transform(F.filter(rule_table(), lambda r: F.arrays_overlap(k, r["k"])), of)))
    return F.array_sort(F.when(F.array_contains(words, "spdx"), F.concat(plain, tags(norm))).otherwise(plain))


def survivors(found: Column) -> Column:
    """(labels, n, weight) of the detections that no other suppresses, in one pass over the sorted array."""
    start = F.struct(
        *(F.lit(-1).alias(f"end{p}") for p in WEIGHTS),
        F.array().cast("array<string>").alias("labels"), F.lit(0).alias("n"), F.lit(0.0).alias("weight"),
    )

    def step(s: Column, d: Column) -> Column:
        end, p = -d["back"], -d["down"]
        cover = F.lit(-1)
        for level in WEIGHTS:
            cover = F.when(p == level, s[f"end{level}"]).otherwise(cover)
        weight = F.lit(0.0)
        for level, w in WEIGHTS.items():
            weight = F.when(p == level, F.lit(w)).otherwise(weight)
        kept = cover < end
        return F.struct(
            *(F.when(p >= level, F.greatest(s[f"end{level}"], end)).otherwise(s[f"end{level}"]).alias(f"end{level}") for level in WEIGHTS),
            F.when(kept, F.array_union(s["labels"], F.array(d["x"]))).otherwise(s["labels"]).alias("labels"),
            (s["n"] + kept.cast("int")).alias("n"),
            F.when(kept, F.greatest(s["weight"], weight)).otherwise(s["weight"]).alias("weight"),
        )

    return F.aggregate(found, start, step, lambda s: F.struct(s["labels"].alias("labels"), s["n"].alias("n"), s["weight"].alias("weight")))


def blanks(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def base_places(norm: Column, n_words: Column) -> Column:
    """For each base phrase: how often it stands, where first and where last."""

    def places(phrase: str, label: str) -> Column:
        size = phrase.count(" ") + 1
        return let(F.split(norm, f"(?<= ){phrase}(?= )", -1), lambda s: F.struct(
            (F.size(s) - 1).alias("n"),
            F.when(F.size(s) > 1, blanks(s[0]) - 1).alias("first"),
            F.when(F.size(s) > 1, n_words - (blanks(F.element_at(s, -1)) - 1) - size).alias("last"),
            F.when(F.size(s) > 1, F.lit(label)).alias("label"),
        ))

    return F.array(*(places(p, x) for p, x in BASE.items()))


def scan(text: Column) -> Column:
    """A struct of n_words, n_base, first_word, last_word, base_labels, labels, n_detections and score."""
    text = F.coalesce(text, F.lit(""))

    def found(words: Column, later: Column) -> Column:
        """``later``: the words with a plus sign behind a version spelt out; the base phrases stand among ``words``."""

        def places(norm: Column) -> Column:
            spelt = F.when(F.size(later) == F.size(words), norm).otherwise(F.concat(F.lit(" "), F.array_join(later, " "), F.lit(" ")))
            own = let(spelt, lambda n: survivors(detections(n, later)))
            pair = F.struct(base_places(norm, F.size(words)).alias("base"), own.alias("own"))
            return let(pair, lambda x: F.struct(
                F.aggregate(x["base"], F.lit(0), lambda n, b: n + b["n"]).alias("n"),
                F.array_min(F.transform(x["base"], lambda b: b["first"])).alias("first"),
                F.array_max(F.transform(x["base"], lambda b: b["last"])).alias("last"),
                F.array_compact(F.transform(x["base"], lambda b: b["label"])).alias("base"),
                x["own"]["labels"].alias("own"), x["own"]["n"].alias("m"), x["own"]["weight"].alias("weight"),
            ))

        return let(F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" ")), places)

    hit = F.when(text.rlike(TRIGGER), let(lower_ascii(text), lambda low: let(
        F.struct(F.regexp_extract_all(low, F.lit(WORD), F.lit(0)).alias("words"), F.when(low.rlike(PLUS), F.regexp_extract_all(F.regexp_replace(low, PLUS, " or later "), F.lit(WORD), F.lit(0))).alias("later")),
        lambda w: found(w["words"], F.coalesce(w["later"], w["words"])))))
    none = F.array().cast("array<string>")
    return let(hit, lambda h: F.struct(
        F.regexp_count(text, F.lit(ANY_CASE_WORD)).cast("long").alias("n_words"),
        F.coalesce(h["n"], F.lit(0)).cast("long").alias("n_base"),
        h["first"].cast("long").alias("first_word"),
        h["last"].cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.coalesce(h["base"], none)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(F.coalesce(h["base"], none), F.coalesce(h["own"], none))), ",").alias("labels"),
        F.coalesce(h["m"], F.lit(0)).cast("long").alias("n_detections"),
        F.greatest(F.coalesce(h["weight"], F.lit(0.0)), F.when(h["n"] > 0, F.lit(BASE_WEIGHT)).otherwise(F.lit(0.0))).alias("score"),
    ))
