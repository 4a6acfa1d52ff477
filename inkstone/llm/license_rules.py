"""The license signatures: fixed values, matched against texts whose words are lower-cased and set apart by one space.

A family is (label, keyword, name patterns, SPDX words). Its names and SPDX words are put into the statement forms
below, which gives several hundred rules. A rule's keyword is a word part that every match contains: it is taken from
the pattern's own fixed text, and the keyword of the family only says which part of that is telling.
"""

from __future__ import annotations

import re
from typing import NamedTuple


class Rule(NamedTuple):
    label: str
    priority: int
    keyword: str
    pattern: str


#: Parts that many rules' matches hold; gate() adds what the others need.
COMMON = ("licen", "rights reserved", " cc ", "creative commons", "gpl", "public domain", "spdx", "copyright", "permission is hereby", "redistribution and use", "software is provided", "proprietary", "beerware", "wtfpl", "cc0", "terms of use", "software", "warrant", "free of charge", "permission")

FAMILIES: list[tuple[str, str, list[str], list[str]]] = [
    ("apache-1.0", "apache", [r"apache(?: software)? license(?: version| v)? v?1(?: 0)?"], ["apache 1 0"]),
    ("apache-1.1", "apache", [r"apache(?: software)? license(?: version| v)? v?1 1"], ["apache 1 1"]),
    ("apache-2.0", "apache", [r"apache(?: software)? license(?: version| v)? v?2(?: 0)?", r"apache 2(?: 0)?(?: license)?"], ["apache 2 0"]),
    ("mit", "mit", [r"mit licen[sc]e", r"mit x11 license", r"expat license"], ["mit"]),
    ("mit-0", "mit", [r"mit no attribution(?: license)?"], ["mit 0"]),
    ("bsd-2-clause", "bsd", [r"(?:bsd )?2 clause bsd license", r"bsd 2 clause license", r"simplified bsd license", r"freebsd license"], ["bsd 2 clause"]),
    ("bsd-3-clause", "bsd", [r"(?:bsd )?3 clause bsd license", r"bsd 3 clause license", r"new bsd license", r"revised bsd license", r"modified bsd license"], ["bsd 3 clause"]),
    ("bsd-4-clause", "bsd", [r"4 clause bsd license", r"bsd 4 clause license", r"original bsd license"], ["bsd 4 clause"]),
    ("0bsd", "bsd", [r"zero clause bsd license", r"bsd zero clause license"], ["0bsd"]),
    ("bsd", "bsd", [r"bsd(?: style)? licen[sc]e"], []),
    ("gpl-1.0", "general public", [r"gnu general public license(?: version| v)? v?1(?: 0)?"], ["gpl 1 0 only", "gpl 1 0"]),
    ("gpl-2.0", "general public", [r"(?:gnu )?general public license(?: version| v)? v?2(?: 0)?"], ["gpl 2 0 only", "gpl 2 0"]),
    ("gpl-2.0", "gpl", [r"(?:gnu )?gpl(?: version)? ?(?:v ?)?2(?: 0)?"], []),
    ("gpl-2.0-or-later", "general public", [r"(?:gnu )?general public license(?: version| v)? v?2(?: 0)? or (?:any )?later"], ["gpl 2 0 or later"]),
    ("gpl-3.0", "general public", [r"(?:gnu )?general public license(?: version| v)? v?3(?: 0)?"], ["gpl 3 0 only", "gpl 3 0"]),
    ("gpl-3.0", "gpl", [r"(?:gnu )?gpl(?: version)? ?(?:v ?)?3(?: 0)?"], []),
    ("gpl-3.0-or-later", "general public", [r"(?:gnu )?general public license(?: version| v)? v?3(?: 0)? or (?:any )?later"], ["gpl 3 0 or later"]),
    ("lgpl-2.0", "lesser", [r"gnu (?:library|lesser) general public license(?: version| v)? v?2(?: 0)?"], ["lgpl 2 0 only", "lgpl 2 0"]),
    ("lgpl-2.1", "lesser", [r"(?:gnu )?lesser general public license(?: version| v)? v?2 1"], ["lgpl 2 1 only", "lgpl 2 1"]),
    ("lgpl-2.1", "lgpl", [r"(?:gnu )?lgpl(?: version)? ?(?:v ?)?2 1"], []),
    ("lgpl-2.1-or-later", "lesser", [r"(?:gnu )?lesser general public license(?: version| v)? v?2 1 or (?:any )?later"], ["lgpl 2 1 or later"]),
    ("lgpl-3.0", "lesser", [r"(?:gnu )?lesser general public license(?: version| v)? v?3(?: 0)?"], ["lgpl 3 0 only", "lgpl 3 0"]),
    ("lgpl-3.0", "lgpl", [r"(?:gnu )?lgpl(?: version)? ?(?:v ?)?3(?: 0)?"], []),
    ("agpl-3.0", "affero", [r"(?:gnu )?affero general public license(?:(?: version| v)? v?3(?: 0)?)?"], ["agpl 3 0 only", "agpl 3 0 or later", "agpl 3 0"]),
    ("agpl-3.0", "agpl", [r"(?:gnu )?agpl(?: version)? ?(?:v ?)?3(?: 0)?"], []),
    ("gfdl-1.1", "documentation", [r"gnu free documentation license(?: version| v)? v?1 1"], ["gfdl 1 1"]),
    ("gfdl-1.2", "documentation", [r"gnu free documentation license(?: version| v)? v?1 2"], ["gfdl 1 2"]),
    ("gfdl-1.3", "documentation", [r"gnu free documentation license(?: version| v)? v?1 3"], ["gfdl 1 3"]),
    ("mpl-1.0", "mozilla", [r"mozilla public license(?: version| v)? v?1(?: 0)?"], ["mpl 1 0"]),
    ("mpl-1.1", "mozilla", [r"mozilla public license(?: version| v)? v?1 1"], ["mpl 1 1"]),
    ("mpl-2.0", "mozilla", [r"mozilla public license(?: version| v)? v?2(?: 0)?"], ["mpl 2 0"]),
    ("epl-1.0", "eclipse", [r"eclipse public license(?: version| v)? v?1(?: 0)?"], ["epl 1 0"]),
    ("epl-2.0", "eclipse", [r"eclipse public license(?: version| v)? v?2(?: 0)?"], ["epl 2 0"]),
    ("edl-1.0", "eclipse", [r"eclipse distribution license(?: version| v)? v?1(?: 0)?"], []),
    ("cpl-1.0", "common public", [r"common public license(?: version| v)? v?1(?: 0)?"], ["cpl 1 0"]),
    ("ipl-1.0", "ibm", [r"ibm public license(?: version| v)? v?1(?: 0)?"], ["ipl 1 0"]),
    ("cddl-1.0", "common development", [r"common development and distribution license(?: version| v)? v?1(?: 0)?"], ["cddl 1 0"]),
    ("cddl-1.1", "common development", [r"common development and distribution license(?: version| v)? v?1 1"], ["cddl 1 1"]),
    ("isc", "isc", [r"isc license", r"internet systems consortium license"], ["isc"]),
    ("zlib", "zlib", [r"zlib license", r"zlib libpng license"], ["zlib"]),
    ("libpng", "libpng", [r"libpng license"], ["libpng", "libpng 2 0"]),
    ("bsl-1.0", "boost", [r"boost software license(?:(?: version| v)? v?1 0)?"], ["bsl 1 0"]),
    ("unlicense", "unlicense", [r"the unlicense", r"unlicense license"], ["unlicense"]),
    ("wtfpl", "wtfpl", [r"wtfpl(?: license)?"], ["wtfpl"]),
    ("wtfpl", "what the f", [r"do what the f\w+ you want to public license"], []),
    ("artistic-1.0", "artistic", [r"artistic license(?: version| v)? v?1(?: 0)?"], ["artistic 1 0"]),
    ("artistic-2.0", "artistic", [r"artistic license(?: version| v)? v?2(?: 0)?"], ["artistic 2 0"]),
    ("psf-2.0", "python", [r"python software foundation license(?:(?: version| v)? v?2)?", r"psf license"], ["psf 2 0"]),
    ("ruby", "ruby", [r"ruby license"], ["ruby"]),
    ("php-3.01", "php", [r"php license(?:(?: version| v)? v?3 01)?"], ["php 3 01"]),
    ("openssl", "openssl", [r"openssl license"], ["openssl"]),
    ("ssleay", "ssleay", [r"ssleay license"], ["ssleay"]),
    ("x11", "x11", [r"x11 license"], ["x11"]),
    ("ncsa", "ncsa", [r"(?:university of illinois )?ncsa open source license"], ["ncsa"]),
    ("postgresql", "postgresql", [r"postgresql licen[sc]e"], ["postgresql"]),
    ("eupl-1.1", "european union", [r"european union public licen[sc]e(?: version| v)? v?1 1"], ["eupl 1 1"]),
    ("eupl-1.2", "european union", [r"european union public licen[sc]e(?: version| v)? v?1 2"], ["eupl 1 2"]),
    ("cecill-2.1", "cecill", [r"cecill(?: free software)? license(?: agreement)?(?: version| v)? v?2 1"], ["cecill 2 1"]),
    ("cecill-b", "cecill", [r"cecill b(?: license)?"], ["cecill b"]),
    ("cecill-c", "cecill", [r"cecill c(?: license)?"], ["cecill c"]),
    ("ms-pl", "microsoft", [r"microsoft public license"], ["ms pl"]),
    ("ms-rl", "microsoft", [r"microsoft reciprocal license"], ["ms rl"]),
    ("osl-3.0", "open software", [r"open software license(?: version| v)? v?3(?: 0)?"], ["osl 3 0"]),
    ("afl-3.0", "academic", [r"academic free license(?: version| v)? v?3(?: 0)?"], ["afl 3 0"]),
    ("ofl-1.1", "sil", [r"sil open font license(?:(?: version| v)? v?1 1)?"], ["ofl 1 1"]),
    ("odbl-1.0", "database", [r"open (?:data commons open )?database license(?: odbl)?(?:(?: version| v)? v?1 0)?"], ["odbl 1 0"]),
    ("odc-by-1.0", "attribution", [r"open data commons attribution license(?:(?: version| v)? v?1 0)?"], ["odc by 1 0"]),
    ("pddl-1.0", "public domain", [r"(?:open data commons )?public domain dedication and license"], ["pddl 1 0"]),
    ("cc0-1.0", "cc0", [r"cc0(?: 1 0)?(?: universal)?(?: license)?"], ["cc0 1 0"]),
    ("cc0-1.0", "zero", [r"creative commons zero(?:(?: version| v)? v?1 0)?(?: universal)?"], []),
    ("json", "good not evil", [r"shall be used for good not evil"], ["json"]),
    ("beerware", "beer", [r"the beer ware license", r"beerware license"], ["beerware"]),
    ("sspl-1.0", "server side", [r"server side public license(?:(?: version| v)? v?1)?"], ["sspl 1 0"]),
    ("busl-1.1", "business source", [r"business source license(?:(?: version| v)? v?1 1)?"], ["busl 1 1"]),
    ("elastic-2.0", "elastic", [r"elastic license(?:(?: version| v)? v?2 0)?"], ["elastic 2 0"]),
    ("commons-clause", "commons clause", [r"commons clause(?: license)?(?: condition)?"], []),
    ("hippocratic-2.1", "hippocratic", [r"hippocratic license(?:(?: version| v)? v?2 1)?"], ["hippocratic 2 1"]),
    ("blueoak-1.0.0", "blue oak", [r"blue oak model license(?: 1 0 0)?"], ["blueoak 1 0 0"]),
    ("upl-1.0", "universal permissive", [r"universal permissive license(?:(?: version| v)? v?1 0)?"], ["upl 1 0"]),
    ("vim", "vim", [r"vim license"], ["vim"]),
    ("curl", "curl", [r"curl license"], ["curl"]),
    ("ijg", "jpeg", [r"independent jpeg group license"], ["ijg"]),
    ("unicode", "unicode", [r"unicode(?: inc)? license(?: agreement)?"], ["unicode dfs 2016", "unicode 3 0"]),
    ("w3c", "w3c", [r"w3c software(?: notice and)? license"], ["w3c"]),
    ("zpl-2.1", "zope", [r"zope public license(?:(?: version| v)? v?2 1)?"], ["zpl 2 1"]),
    ("qpl-1.0", "q public", [r"q public license(?:(?: version| v)? v?1 0)?"], ["qpl 1 0"]),
    ("lppl-1.3c", "latex", [r"latex project public license(?:(?: version| v)? v?1 3c?)?"], ["lppl 1 3c"]),
    ("ecl-2.0", "educational", [r"educational community license(?:(?: version| v)? v?2 0)?"], ["ecl 2 0"]),
    ("apsl-2.0", "apple public", [r"apple public source license(?:(?: version| v)? v?2(?: 0)?)?"], ["apsl 2 0"]),
    ("cpal-1.0", "common public", [r"common public attribution license(?:(?: version| v)? v?1(?: 0)?)?"], ["cpal 1 0"]),
    ("mulanpsl-2.0", "mulan", [r"mulan permissive software license(?:(?: version| v)? v?2)?"], ["mulanpsl 2 0"]),
    ("npl-1.1", "netscape", [r"netscape public license(?:(?: version| v)? v?1(?: 1| 0)?)?"], ["npl 1 1"]),
    ("spl-1.0", "sun public", [r"sun public license(?:(?: version| v)? v?1(?: 0)?)?"], ["spl 1 0"]),
    ("sleepycat", "sleepycat", [r"sleepycat license"], ["sleepycat"]),
    ("nasa-1.3", "nasa", [r"nasa open source agreement(?:(?: version| v)? v?1 3)?"], ["nasa 1 3"]),
    ("rpl-1.5", "reciprocal", [r"reciprocal public license(?:(?: version| v)? v?1 5)?"], ["rpl 1 5"]),
    ("lpl-1.02", "lucent", [r"lucent public license(?:(?: version| v)? v?1 02)?"], ["lpl 1 02"]),
    ("efl-2.0", "eiffel", [r"eiffel forum license(?:(?: version| v)? v?2(?: 0)?)?"], ["efl 2 0"]),
    ("hpnd", "historical permission", [r"historical permission notice and disclaimer"], ["hpnd"]),
    ("ntp", "ntp", [r"ntp license"], ["ntp"]),
    ("miros", "miros", [r"miros licen[sc]e"], ["miros"]),
    ("zend-2.0", "zend", [r"zend engine license", r"zend license"], ["zend 2 0"]),
    ("xfree86-1.1", "xfree86", [r"xfree86 license(?:(?: version| v)? v?1 1)?"], ["xfree86 1 1"]),
    ("wxwindows", "wxwindows", [r"wxwindows library licen[sc]e"], ["wxwindows"]),
    ("watcom-1.0", "watcom", [r"sybase open watcom public license(?:(?: version| v)? v?1(?: 0)?)?"], ["watcom 1 0"]),
    ("cern-ohl-1.2", "cern", [r"cern open hardware licen[sc]e(?:(?: version| v)? v?1 2)?"], ["cern ohl 1 2"]),
    ("cern-ohl-s-2.0", "cern", [r"cern ohl s(?: v2)?"], ["cern ohl s 2 0"]),
    ("ubuntu-font-1.0", "ubuntu", [r"ubuntu font licen[sc]e(?:(?: version| v)? v?1 0)?"], ["ubuntu font 1 0"]),
    ("bitstream-vera", "bitstream", [r"bitstream vera (?:fonts )?(?:copyright|license)"], ["bitstream vera"]),
    ("polyform-noncommercial-1.0.0", "polyform", [r"polyform noncommercial license(?: 1 0 0)?"], ["polyform noncommercial 1 0 0"]),
    ("polyform-small-business-1.0.0", "polyform", [r"polyform small business license(?: 1 0 0)?"], ["polyform small business 1 0 0"]),
    ("parity-7.0.0", "parity", [r"parity public license(?: 7 0 0)?"], ["parity 7 0 0"]),
    ("prosperity-3.0.0", "prosperity", [r"prosperity public license(?: 3 0 0)?"], ["prosperity 3 0 0"]),
    ("openrail", "openrail", [r"(?:creativeml )?open ?rail m? ?license", r"bigscience rail license"], []),
    ("osl-2.1", "open software", [r"open software license(?: version| v)? v?2 1"], ["osl 2 1"]),
    ("afl-2.1", "academic", [r"academic free license(?: version| v)? v?2 1"], ["afl 2 1"]),
    ("cnri-python", "cnri", [r"cnri open source license agreement", r"cnri python license"], ["cnri python"]),
    ("fair", "fair", [r"the fair license"], ["fair"]),
    ("aal", "assurance", [r"attribution assurance license"], ["aal"]),
    ("vsl-1.0", "vovida", [r"vovida software license(?:(?: version| v)? v?1 0)?"], ["vsl 1 0"]),
    ("simpl-2.0", "simple public", [r"simple public license(?:(?: version| v)? v?2 0)?"], ["simpl 2 0"]),
    ("gpl-classpath-exception", "classpath", [r"classpath exception"], []),
    ("ogl-uk-3.0", "open government", [r"open government licen[sc]e(?:(?: version| v)? v?3 0)?"], ["ogl uk 3 0"]),
]

#: Creative Commons licenses come from their elements and versions.
CC_ELEMENTS = [("by", "attribution"), ("by sa", "attribution share ?alike"), ("by nc", "attribution non ?commercial"), ("by nd", "attribution no ?deriv(?:ative)?s"), ("by nc sa", "attribution non ?commercial share ?alike"), ("by nc nd", "attribution non ?commercial no ?deriv(?:ative)?s")]
CC_VERSIONS = ["1 0", "2 0", "2 5", "3 0", "4 0"]

#: Whole sentences that name no license.
SENTENCES: list[tuple[str, int, str, str]] = [
    # permissive
    ("mit", 4, "permission is hereby", r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit", 4, "to deal in", r"to deal in the software without restriction"),
    ("mit", 4, "substantial portions", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", 3, "furnished", r"to permit persons to whom the software is furnished to do so"),
    ("mit", 3, "copyright holders", r"in no event shall the authors or copyright holders be liable for any claim damages or other liability"),
    ("mit", 3, "sublicense", r"use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("isc", 4, "permission to use", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", 3, "appear in all copies", r"provided that the above copyright notice and this permission notice appear in all copies"),
    ("isc", 3, "disclaims", r"the software is provided as is and the author disclaims all warranties"),
    ("hpnd", 3, "supporting documentation", r"that both that copyright notice and this permission notice appear in supporting documentation"),
    ("bsd", 3, "redistribution", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", 3, "source code must retain", r"redistributions of source code must retain the above copyright notice"),
    ("bsd", 3, "binary form must", r"redistributions in binary form must reproduce the above copyright notice"),
    ("bsd", 2, "copyright holders", r"this software is provided by the (?:copyright holders|author|authors|regents)(?: and contributors)? as is"),
    ("bsd", 2, "contributors be liable", r"in no event shall the (?:copyright owner|copyright holder|regents|author)(?: or contributors)? be liable"),
    ("bsd-3-clause", 4, "neither the name", r"neither the name of (?:the )?(?:\S+ ){1,12}?nor the names of its contributors"),
    ("bsd-3-clause", 3, "endorse or promote", r"may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-4-clause", 4, "advertising materials", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("bsd-2-clause-patent", 4, "patent", r"hereby grants to those receiving rights under this license a perpetual worldwide non exclusive no charge royalty free"),
    ("zlib", 4, "altered source", r"altered source versions must be plainly marked as such"),
    ("zlib", 4, "misrepresented", r"the origin of this software must not be misrepresented"),
    ("zlib", 3, "held liable", r"in no event will the authors be held liable for any damages arising from the use of this software"),
    ("zlib", 3, "may not be removed", r"this notice may not be removed or altered from any source distribution"),
    ("libpng", 4, "misrepresented", r"the origin of this source code must not be misrepresented"),
    ("bsl-1.0", 4, "organization obtaining", r"to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("bsl-1.0", 3, "machine executable", r"solely in the form of machine executable object code generated by a source language processor"),
    ("ncsa", 4, "deal with the software", r"to deal with the software without restriction"),
    ("postgresql", 4, "university of california", r"in no event shall the university of california be liable to any party for direct indirect special incidental or consequential damages"),
    ("x11", 3, "x consortium", r"except as contained in this notice the name of the x consortium shall not be used in advertising"),
    ("curl", 3, "name of a copyright", r"except as contained in this notice the name of a copyright holder shall not be used in advertising"),
    ("ijg", 4, "independent jpeg", r"based in part on the work of the independent jpeg group"),
    ("openssl", 4, "openssl project", r"this product includes software developed by the openssl project"),
    ("ssleay", 4, "eric young", r"cryptographic software written by eric young"),
    ("apache-1.1", 4, "apache software", r"this product includes software developed by the apache software foundation"),
    ("apache-1.0", 4, "apache group", r"this product includes software developed by the apache group"),
    ("php-3.01", 4, "php", r"this product includes php software"),
    ("python", 4, "making python available", r"psf is making python available to licensee on an as is basis"),
    ("psf-2.0", 4, "between the python", r"this license agreement is between the python software foundation"),
    ("cnri-python", 4, "cnri", r"cnri is making python (?:\S+ ){0,3}?available to licensee on an as is basis"),
    ("vim", 4, "copies of vim", r"there are no restrictions on distributing unmodified copies of vim"),
    ("json", 4, "good not evil", r"the software shall be used for good not evil"),
    ("beerware", 4, "buy me a beer", r"you can buy me a beer in return"),
    ("wtfpl", 4, "you just do", r"you just do what the f\w+ you want to"),
    ("unicode", 4, "unicode data files", r"a copy of the unicode data files and any associated documentation"),
    ("w3c", 4, "licensee agree", r"by obtaining using and or copying this work you the licensee agree that you have read"),
    ("upl-1.0", 4, "larger works", r"to whom the larger works are contributed"),
    ("mit-cmu", 3, "carnegie mellon", r"carnegie mellon university disclaims all warranties with regard to this software"),
    ("ntp", 3, "author makes no", r"makes no representations about the suitability (?:of )?this software for any purpose"),
    ("boehm-gc", 3, "gc", r"permission is hereby granted to use or copy this program for any purpose provided the above notices are retained on all copies"),
    # apache
    ("apache-2.0", 4, "except in compliance", r"you may not use this file except in compliance with the license"),
    ("apache-2.0", 4, "agreed to in writing", r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("apache-2.0", 3, "conditions of any kind", r"without warranties or conditions of any kind either express or implied"),
    ("apache-2.0", 4, "hereby grants to you", r"each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable"),
    ("apache-2.0", 3, "derivative works shall", r"derivative works shall mean any work whether in source or object form"),
    ("apache-2.0", 3, "contribution shall", r"contribution shall mean any work of authorship including the original version"),
    ("apache-2.0", 3, "other recipients", r"you must give any other recipients of the work or derivative works a copy of this license"),
    ("apache-2.0", 3, "modified files", r"you must cause any modified files to carry prominent notices"),
    ("apache-2.0", 4, "apache org", r"apache org licenses license 2 0"),
    # copyleft
    ("gpl", 3, "this program is free", r"this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl-2.0-or-later", 4, "either version 2", r"either version 2 of the license or at your option any later version"),
    ("gpl-3.0-or-later", 4, "either version 3", r"either version 3 of the license or at your option any later version"),
    ("gpl-2.0", 4, "version 2 of the gnu", r"version 2 of the gnu general public license as published by the free software foundation"),
    ("gpl-3.0", 4, "version 3 of the gnu", r"version 3 of the gnu general public license as published by the free software foundation"),
    ("gpl", 3, "should have received", r"you should have received a copy of the gnu general public license"),
    ("gpl", 2, "in the hope", r"this program is distributed in the hope that it will be useful but without any warranty"),
    ("gpl-2.0", 3, "most software", r"the licenses for most software are designed to take away your freedom to share and change it"),
    ("gpl-3.0", 3, "free copyleft", r"the gnu general public license is a free copyleft license for software and other kinds of works"),
    ("gpl", 2, "not price", r"when we speak of free software we are referring to freedom not price"),
    ("gpl-2.0", 3, "expressly provided", r"you may not copy modify sublicense or distribute the program except as expressly provided under this license"),
    ("gpl", 2, "proprietary programs", r"does not permit incorporating your program into proprietary programs"),
    ("gpl", 2, "free software foundation", r"if not write to the free software foundation"),
    ("gpl", 1, "verbatim copies", r"everyone is permitted to copy and distribute verbatim copies of this license document"),
    ("gpl-3.0", 3, "corresponding source", r"the corresponding source for a work in object code form means all the source code needed"),
    ("gpl-3.0", 3, "anti circumvention", r"protecting users legal rights from anti circumvention law"),
    ("gpl-linking-exception", 4, "special exception", r"as a special exception the copyright holders of this library give you permission to link this library"),
    ("gpl-classpath-exception", 4, "independent modules", r"linking this library statically or dynamically with other modules is making a combined work"),
    ("lgpl", 3, "this library is free", r"this library is free software you can redistribute it and or modify it"),
    ("lgpl", 3, "lesser general", r"you should have received a copy of the gnu lesser general public license"),
    ("lgpl-2.1-or-later", 4, "either version 2 1", r"either version 2 1 of the license or at your option any later version"),
    ("lgpl", 3, "library general", r"you should have received a copy of the gnu library general public license"),
    ("lgpl-2.1", 3, "uses the library", r"a work that uses the library"),
    ("agpl-3.0", 4, "affero", r"you should have received a copy of the gnu affero general public license"),
    ("agpl-3.0", 4, "interacting", r"all users interacting with it remotely through a computer network"),
    ("agpl-3.0-or-later", 4, "affero", r"gnu affero general public license as published by the free software foundation either version 3 of the license or"),
    ("gfdl", 3, "invariant sections", r"with no invariant sections no front cover texts and no back cover texts"),
    ("gfdl", 3, "copy distribute and or modify this document", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("mpl-2.0", 4, "source code form", r"this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-2.0", 4, "mpl was not", r"if a copy of the mpl was not distributed with this file"),
    ("mpl-1.1", 4, "contents of this file", r"the contents of this file are subject to the mozilla public license version 1 1"),
    ("mpl-2.0", 3, "covered software", r"covered software is provided under this license on an as is basis"),
    ("mpl-2.0", 3, "secondary licenses", r"this source code form is incompatible with secondary licenses"),
    ("npl-1.1", 4, "netscape", r"the contents of this file are subject to the netscape public license"),
    ("epl", 4, "accompanying materials", r"this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("epl", 3, "accompanying program", r"the accompanying program is provided under the terms of this eclipse public license"),
    ("cpl-1.0", 3, "accompanying program", r"the accompanying program is provided under the terms of this common public license"),
    ("ipl-1.0", 3, "accompanying program", r"the accompanying program is provided under the terms of this ibm public license"),
    ("cddl", 4, "common development", r"the contents of this file are subject to the terms of the common development and distribution license"),
    ("cddl", 3, "cddl header", r"cddl header start"),
    ("eupl", 3, "eupl", r"licensed under the eupl"),
    ("cecill", 4, "french law", r"governed by the cecill (?:b |c )?license under french law"),
    ("osl", 3, "open software license", r"licensed under the open software license"),
    ("artistic", 3, "intent of this document", r"the intent of this document is to state the conditions under which a package may be copied"),
    ("artistic-2.0", 3, "given free software", r"this license establishes the terms under which a given free software package may be copied modified distributed"),
    ("artistic", 3, "same terms as perl", r"under the same terms as perl itself"),
    ("lppl", 3, "lppl", r"this work has the lppl maintenance status"),
    ("lppl", 4, "latex project", r"it may be distributed and or modified under the conditions of the latex project public license"),
    ("ms-pl", 3, "accompanying software", r"this license governs use of the accompanying software"),
    ("qpl-1.0", 3, "q public", r"may be distributed under the terms of the q public license"),
    ("sleepycat", 3, "accompanying software that uses", r"complete source code for the db software and any accompanying software that uses the db software"),
    ("apsl-2.0", 4, "apple public", r"subject to the apple public source license"),
    ("ofl-1.1", 4, "font software is", r"this font software is licensed under the sil open font license"),
    ("ofl-1.1", 3, "sold by itself", r"neither the font software nor any of its individual components in original or modified versions may be sold by itself"),
    ("ofl-1.1", 2, "reserved font name", r"with reserved font name"),
    # source available
    ("sspl-1.0", 4, "as a service", r"if you make the functionality of the program or a modified version available to third parties as a service"),
    ("busl-1.1", 4, "non production use", r"make non production use of the licensed work"),
    ("busl-1.1", 3, "change date", r"on the change date"),
    ("elastic-2.0", 4, "managed service", r"you may not provide the software to third parties as a hosted or managed service"),
    ("commons-clause", 4, "right to sell", r"the license does not grant to you the right to sell the software"),
    ("openrail", 3, "use based restrictions", r"use based restrictions"),
    ("llama", 4, "community license agreement", r"llama (?:\d )?(?:\d )?community license agreement"),
    ("gemma", 4, "gemma", r"gemma terms of use"),
    ("non-commercial", 2, "non commercial", r"for non ?commercial use only"),
    ("non-commercial", 2, "research purposes", r"for (?:academic|research|non ?commercial research) purposes only"),
    ("non-commercial", 2, "personal use", r"for personal use only"),
    # creative commons and data
    ("cc0-1.0", 4, "waived all copyright", r"has waived all copyright and related or neighboring rights"),
    ("cc0-1.0", 4, "deed has dedicated", r"the person who associated a work with this deed has dedicated the work to the public domain"),
    ("creative-commons", 3, "this work is licensed", r"this work is licensed under a creative commons"),
    ("creative-commons", 2, "redistribute the material", r"copy and redistribute the material in any medium or format"),
    ("creative-commons", 2, "appropriate credit", r"you must give appropriate credit provide a link to the license and indicate if changes were made"),
    ("cc-by-nc", 3, "commercial purposes", r"you may not use the material for commercial purposes"),
    ("cc-by-sa", 3, "same license", r"you must distribute your contributions under the same license as the original"),
    ("cc-by-nd", 3, "modified material", r"if you remix transform or build upon the material you may not distribute the modified material"),
    ("creative-commons", 1, "creative commons", r"creative commons licen[sc]e"),
    ("cc-by", 1, " cc ", r"cc by"),
    ("odbl-1.0", 4, "open database", r"is made available under the open database license"),
    ("odbl-1.0", 3, "individual contents", r"any rights in individual contents of the database are licensed under the database contents license"),
    ("odc-by-1.0", 3, "attribution license", r"is made available under the open data commons attribution license"),
    ("ogl-uk-3.0", 3, "public sector", r"contains public sector information licensed under the open government licen[sc]e"),
    # public domain
    ("unlicense", 4, "unencumbered", r"free and unencumbered software released into the public domain"),
    ("unlicense", 3, "anyone is free", r"anyone is free to copy modify publish use compile sell or distribute this software"),
    ("unlicense", 3, "unlicense", r"please refer to (?:http |https )?unlicense org"),
    ("public-domain", 2, "public domain", r"(?:released|placed|dedicated) (?:in|into|to) the public domain"),
    ("public-domain", 1, "public domain", r"public domain"),
    ("public-domain", 3, "blessing", r"may you do good and not evil"),
    ("public-domain", 3, "disclaims copyright", r"the author disclaims copyright to this source code"),
    ("public-domain", 2, "no copyright", r"no copyright is claimed"),
    ("public-domain", 2, "government work", r"is a work of the (?:united states|u s) government"),
    ("no-known-copyright", 2, "known copyright", r"no known copyright restrictions"),
    # reserved rights and warranties
    ("no-warranty", 1, "provided", r"software is provided as is without warranty of any kind"),
    ("no-warranty", 1, "provided as is", r"this software is provided as is without any express or implied warranty"),
    ("no-warranty", 1, "merchantability", r"warranties of merchantability (?:and )?fitness for a particular purpose"),
    ("proprietary", 3, "proprietary", r"proprietary and confidential"),
    ("proprietary", 2, "proprietary", r"proprietary license"),
    ("proprietary", 3, "strictly prohibited", r"unauthorized copying of this file via any medium is strictly prohibited"),
    ("proprietary", 3, "confidential and proprietary", r"contains confidential and proprietary information"),
    ("proprietary", 2, "may be reproduced", r"no part of this (?:publication|document|book|work|material) may be reproduced"),
    ("proprietary", 2, "reverse engineer", r"you may not reverse engineer decompile or disassemble"),
    ("proprietary", 3, "licensed not sold", r"is licensed not sold"),
    ("proprietary", 2, "license agreement", r"end user license agreement"),
    ("proprietary", 2, "prior written", r"prior written (?:permission|consent) of"),
    ("proprietary", 2, "trade secret", r"is protected by trade secret"),
    ("reserved", 1, "rights reserved", r"(?:all|some|no) rights reserved"),
    ("copyright", 1, "copyright", r"copyright(?: c)? (?:19|20)\d\d"),
    ("copyright", 1, "copyright law", r"protected by copyright law"),
    ("copyright", 1, "copyright holder", r"reproduced with permission of the copyright (?:holder|owner)"),
    ("terms-of-use", 1, "terms of use", r"subject to the terms of use"),
    ("terms-of-use", 1, "terms of service", r"subject to the terms of service"),
    ("gpl", 1, "general public", r"general public license"),
    ("gpl", 1, "gpl", r"gnu gpl"),
]


_GROUP = re.compile(r"\(\?:[^()]*\)(?:\?|\{[\d,]+\}\??)?")
_LOOSE = re.compile(r"\[[^\]]*\]|\\[a-zA-Z]\+?|[^\x00]\?")


def fixed_parts(pattern: str) -> list[str]:
    """The runs of characters that every match of a pattern holds, with the spaces around it; groups count as unknown."""
    held = f" {pattern} "
    while (less := _GROUP.sub("\0", held)) != held:
        held = less
    return [x for x in _LOOSE.sub("\0", held).split("\0") if x.strip()]


def keyword_of(pattern: str, telling: str) -> str:
    """The longest run that every match of a pattern holds, of those with the telling part if there are any."""
    parts = fixed_parts(pattern)
    return max([x for x in parts if telling in x] or parts, key=len)


def gate(phrases: tuple[str, ...] = ()) -> list[str]:
    """Parts of which every match of any rule, and every phrase, holds one."""
    needed = [(r.pattern, r.keyword) for r in rules()] + [(p, f" {p} ") for p in phrases]
    found = {next((c for c in COMMON if any(c in x for x in fixed_parts(pattern))), keyword) for pattern, keyword in needed}
    return sorted(x for x in found if not any(y != x and y in x for y in found))


def _forms(label: str, keyword: str, name: str) -> list[Rule]:
    """A name by itself, and in the statements that say a work is under it."""
    keyword = keyword_of(name, keyword)
    return [
        Rule(label, 2, keyword, name),
        Rule(label, 4, keyword, rf"(?:licen[sc]ed|released|distributed|available|published|provided|made available) under (?:the )?(?:terms of )?(?:the )?{name}"),
        Rule(label, 3, keyword, rf"(?:governed by|subject to) (?:the )?(?:terms of )?(?:the )?{name}"),
    ]


def _rule(label: str, priority: int, keyword: str, pattern: str) -> Rule:
    return Rule(label, priority, keyword_of(pattern, keyword), pattern)


def rules() -> list[Rule]:
    """All rules, first those of higher priority; the order settles nothing else."""
    found: list[Rule] = []
    for label, keyword, names, spdx in FAMILIES:
        for name in names:
            found += _forms(label, keyword, name)
        for words in spdx:
            found.append(_rule(label, 5, "spdx", rf"spdx license identifier {words}"))
    for short, long in CC_ELEMENTS:
        label = "cc-" + short.replace(" ", "-")
        for version in CC_VERSIONS:
            dotted = version.replace(" ", ".")
            found += _forms(f"{label}-{dotted}", " cc ", rf"cc {short} {version}")
            found.append(_rule(f"{label}-{dotted}", 5, "spdx", rf"spdx license identifier cc {short} {version}"))
            found.append(_rule(f"{label}-{dotted}", 4, "creativecommons", rf"creativecommons org licenses {short} {version}"))
        found += _forms(label, "creative commons", rf"creative commons {long}(?: \d \d)?(?: international| unported)?(?: license)?")
        found += _forms(label, " cc ", rf"cc {short}")
    found += [_rule(*s) for s in SENTENCES]
    return sorted(found, key=lambda r: (-r.priority, r.label, r.pattern))
