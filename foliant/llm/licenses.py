"""License scans by ordered signature rules, in DataFrame and SQL functions only.

A keyword prefilter leaves the few documents that can hold a license. They are reduced to
lower-case words joined by single blanks, and each rule with one of its own keywords present is
matched.
Detections are intervals of words. A detection goes if another one of a better priority contains
its interval (of the same priority: if a strictly longer one does, or an equal one of an earlier
rule); what is left gives the labels, in addition to the base phrases, which always count. Nothing
is detected right behind a negation ("not licensed under the ...").

Everything happens within a document's row: no shuffle, whatever the skew.

Cases: a null or empty text has no words and no labels, null positions and score 0. Overlapping
places of one phrase all count; places of one rule are taken from the left and don't overlap. The score is the share of the text's words that detections and
base phrases cover, 0 to 1; it is 0 without either.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower

#: Words: runs of letters, digits and everything beyond ASCII (A-Z lower-cased before).
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same of a text in any case, as the characters that are in and without stepping back, which the engine counts faster.
WORD_ANY_CASE = r"[0-9A-Za-z\x{80}-\x{10FFFF}]++"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Fixed phrases of the contract and their labels.
BASE = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)


#: Priorities are 1 to this.
PRIORITIES = 4


class Rule(NamedTuple):
    """A regular expression over words joined by blanks (whole words); priority 1 goes first."""

    label: str
    keyword: str
    regex: str
    priority: int


#: Licenses by family: label, name as a regular expression, and the phrases of which one must be there.
#: {v} stands for each of the versions.
_NAMES = (
    ("gpl-{v}", r"(?:gnu )?(?:general public license|gpl)(?: as published by the free software foundation)?(?: either)?(?: version| v)? ?{w}", "gpl|general public", ("1", "2", "3")),
    ("lgpl-{v}", r"(?:gnu )?(?:lesser|library) general public license(?: version| v)? ?{w}|(?:gnu )?lgpl(?: version| v)? ?{w}", "lgpl|lesser general|library general", ("2", "2 1", "3")),
    ("agpl-{v}", r"(?:gnu )?affero general public license(?: version| v)? ?{w}|(?:gnu )?agpl(?: version| v)? ?{w}", "agpl|affero", ("1", "3")),
    ("gfdl-{v}", r"(?:gnu )?free documentation license(?: version| v)? ?{w}|gfdl(?: version| v)? ?{w}", "gfdl|documentation license", ("1 1", "1 2", "1 3")),
    ("apache-{v}", r"apache(?: software)? license(?: version| v)? ?{w}|apache {w}(?: license)?", "apache", ("1", "1 1", "2", "2 0")),
    ("mpl-{v}", r"mozilla public license(?: version| v)? ?{w}|mpl(?: version| v)? ?{w}", "mozilla|mpl", ("1", "1 1", "2", "2 0")),
    ("epl-{v}", r"eclipse public license(?: version| v)? ?{w}|epl(?: version| v)? ?{w}", "eclipse public|epl", ("1", "1 0", "2", "2 0")),
    ("eupl-{v}", r"european union public licen[cs]e(?: version| v)? ?{w}|eupl(?: version| v)? ?{w}", "european union public|eupl", ("1 0", "1 1", "1 2")),
    ("cddl-{v}", r"common development and distribution license(?: version| v)? ?{w}|cddl(?: version| v)? ?{w}", "cddl|distribution license", ("1 0", "1 1")),
    ("cpl-{v}", r"common public license(?: version| v)? ?{w}", "common public", ("0 5", "1 0")),
    ("artistic-{v}", r"artistic license(?: version| v)? ?{w}", "artistic license", ("1 0", "2 0")),
    ("afl-{v}", r"academic free license(?: version| v)? ?{w}", "academic free", ("1 1", "1 2", "2 0", "2 1", "3 0")),
    ("osl-{v}", r"open software license(?: version| v)? ?{w}", "open software", ("1 0", "2 0", "2 1", "3 0")),
    ("ofl-{v}", r"(?:sil )?open font license(?: version| v)? ?{w}", "open font", ("1 0", "1 1")),
    ("odbl-{v}", r"open data(?:base| commons open database) license(?: version| v)? ?{w}", "open data", ("1 0",)),
    ("psf-{v}", r"(?:python software foundation|psf) license(?: version| v)? ?{w}", "psf license|python software", ("2",)),
    ("php-{v}", r"php license(?: version| v)? ?{w}", "php license", ("3 0", "3 01")),
    ("zpl-{v}", r"zope public license(?: version| v)? ?{w}|zpl(?: version| v)? ?{w}", "zope public|zpl", ("1 1", "2 0", "2 1")),
    ("lppl-{v}", r"latex project public license(?: version| v)? ?{w}|lppl(?: version| v)? ?{w}", "latex project|lppl", ("1 0", "1 2", "1 3")),
    ("cecill-{v}", r"cecill(?: license| version| v)? ?{w}", "cecill", ("1", "2", "2 1")),
    ("bsl-{v}", r"boost software license(?: version| v)? ?{w}", "boost software", ("1 0",)),
    ("busl-{v}", r"business source license(?: version| v)? ?{w}", "business source", ("1 1",)),
    ("ms-{v}", r"microsoft {w} license", "microsoft public|microsoft reciprocal", ("public", "reciprocal")),
    ("bsd-{v}-clause", r"bsd {w} clause|{w} clause bsd|{w} clause license", "bsd|clause license", ("0", "1", "2", "3", "4")),
    ("cc0-{v}", r"cc0 ?{w}|creative commons zero(?: version| v)? ?{w}", "cc0|commons zero", ("1 0",)),
)
#: Creative Commons elements, as codes and as words, combined with versions below.
_CC = (
    ("by", "attribution"), ("by-sa", "attribution share ?alike"), ("by-nd", "attribution no ?deriv(?:ative)?s?(?: works)?"),
    ("by-nc", "attribution non ?commercial"), ("by-nc-sa", "attribution non ?commercial share ?alike"),
    ("by-nc-nd", "attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?"),
)
_CC_VERSIONS = ("1 0", "2 0", "2 1", "2 5", "3 0", "4 0")
#: Licenses without versions: label, regular expression, keyword.
_PLAIN = (
    ("mit", r"(?:the )?mit licen[cs]e|licen[cs]ed under (?:the )?mit|permission is hereby granted free of charge to any person obtaining a copy", "mit licen|under mit|under the mit|permission is hereby"),
    ("isc", r"(?:the )?isc licen[cs]e|permission to use copy modify and or distribute this software for any purpose", "isc licen|permission to use copy"),
    ("bsd", r"(?:the )?(?:new |modified |simplified |revised )?bsd(?: style)? licen[cs]e|redistribution and use in source and binary forms", "bsd|redistribution and use"),
    ("zlib", r"zlib(?: libpng)? licen[cs]e", "zlib li"), ("unlicense", r"(?:the )?unlicense", "unlicense|the unlicense"), ("wtfpl", r"wtfpl|do what the fuck you want to public license", "wtfpl|do what the"),
    ("public-domain", r"(?:released|dedicated|placed) (?:in|in to|into|to) the public domain|public domain dedication", "public domain"),
    ("gpl", r"gnu general public license|gnu gpl|licensed under the gpl", "gnu g|the gpl"), ("lgpl", r"gnu lesser general public license|gnu lgpl", "gnu l"),
    ("agpl", r"gnu affero general public license|gnu agpl", "gnu a"), ("gfdl", r"gnu free documentation license", "gnu free"),
    ("apache", r"apache(?: software)? license|licensed under the apache", "apache"), ("mpl", r"mozilla public license", "mozilla public"), ("epl", r"eclipse public license", "eclipse public"),
    ("artistic", r"artistic license", "artistic license"), ("openssl", r"openssl license", "openssl license"), ("ofl", r"(?:sil )?open font license", "open font"), ("bsl", r"boost software license", "boost software"),
    ("cc", r"creative commons(?: licen[cs]e)?", "creative commons"), ("json", r"software shall be used for good not evil", "good not evil"), ("beerware", r"beer ?ware licen[cs]e|buy me a beer", "beer ware|beerware|me a beer"),
    ("ncsa", r"university of illinois(?: ncsa)? open source license", "university of illinois"), ("x11", r"x11 license|x consortium license", "x11 license|x consortium"), ("sleepycat", r"sleepycat license", "sleepycat license"),
    ("postgresql", r"postgresql license", "postgresql license"), ("ijg", r"independent jpeg group", "independent jpeg"), ("libtiff", r"libtiff license", "libtiff license"), ("curl", r"curl license", "curl license"),
    ("proprietary", r"all rights reserved|proprietary and confidential|(?:may|must) not be (?:copied|reproduced|distributed) without (?:the )?(?:prior )?(?:written )?permission", "all rights reserved|proprietary and|may not be|must not be"),
)
#: Sentences of notices, grants, conditions, disclaimers and identifiers: label, keywords, regular
#: expression. They name their license by its own wording, so they go before names.
_SENTENCES = """
mit | without restriction including | to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies
mit | all copies or substantial | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit | mit license mit | license mit license mit|spdx mit
mit-0 | mit no attribution,mit 0 | mit no attribution(?: license)?|mit 0(?: license)?
mit-advertising | used in advertising or otherwise | except as contained in this notice the names? of .{1,120}? shall not be used in advertising or otherwise to promote the sale
x11 | x consortium shall not | the name of the x consortium shall not be used in advertising
expat | expat licen | (?:the )?expat licen[cs]e
isc | provided that the above copyright notice | permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice
0bsd | zero clause bsd,0bsd,bsd zero | zero clause bsd(?: license)?|bsd zero clause(?: license)?|0bsd
bsd-2-clause | simplified bsd,freebsd license | (?:the )?(?:simplified bsd|freebsd) licen[cs]e
bsd-3-clause | new bsd,modified bsd,revised bsd | (?:the )?(?:new|modified|revised) bsd licen[cs]e
bsd-3-clause | neither the name | neither the names? of .{1,120}? nor the names of (?:its|their|the) contributors may be used to endorse or promote products
bsd-4-clause | all advertising materials,original bsd | all advertising materials mentioning features or use of this software must display|(?:the )?original bsd licen[cs]e
bsd | source code must retain | redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
bsd | binary form must reproduce | redistributions in binary form must reproduce the above copyright notice this list of conditions
bsd-patent | bsd 2 clause plus patent,bsd plus patent | bsd(?: 2 clause)? plus patent(?: license)?
bsd-source-code | bsd source code | bsd source code attribution
apache-2.0 | except in compliance with the license | you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0
apache-2.0 | apache org licenses | https? www apache org licenses license 2 0(?: txt| html)?
apache-1.1 | apache org licenses,apache software foundation | this product includes software developed by the apache software foundation
apache-2.0-llvm | llvm exception | apache(?: license)?(?: version)?(?: v)? ?2 0 with llvm exceptions?
gpl-2.0-or-later | either version 2 of the license | gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version
gpl-3.0-or-later | either version 3 of the license | gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version
lgpl-2.1-or-later | either version 2 1 of the license | gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version
lgpl-3.0-or-later | either version 3 of the license | gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version
agpl-3.0-or-later | either version 3 of the license | gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version
gpl-2.0-only | gpl 2 0 only,version 2 of the license as | gpl 2 0 only|general public license version 2 of the license as published by the free software foundation and no later version
gpl-3.0-only | gpl 3 0 only | gpl 3 0 only
gpl-2.0-or-later | gpl 2 0 or later,gplv2 or later | gpl 2 0 or later|gplv2 or later
gpl-3.0-or-later | gpl 3 0 or later,gplv3 or later | gpl 3 0 or later|gplv3 or later
gpl-2.0 | gplv2,gpl2 | gplv2|gpl2
gpl-3.0 | gplv3,gpl3 | gplv3|gpl3
lgpl-2.1 | lgplv2 1 | lgplv2 1
lgpl-3.0 | lgplv3 | lgplv3
agpl-3.0 | agplv3 | agplv3
gpl | even the implied warranty of merchantability | distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license
lgpl | even the implied warranty of merchantability | distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu (?:lesser|library) general public license
agpl | even the implied warranty of merchantability | distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu affero general public license
gpl | received a copy of the gnu general,a copy of the gnu general | you should have received a copy of the gnu general public license
lgpl | received a copy of the gnu lesser,received a copy of the gnu library | you should have received a copy of the gnu (?:lesser|library) general public license
agpl | received a copy of the gnu affero | you should have received a copy of the gnu affero general public license
gpl-classpath | classpath exception | (?:gpl|general public license)(?: version| v)? ?2(?: 0)? with(?: the)? classpath exception|as a special exception .{1,200}? classpath exception
gpl-linking | linking exception,runtime library exception,gcc runtime library exception | (?:gpl|general public license) with(?: a| the)?(?: gcc)? (?:runtime library|linking) exception
gpl-font | font exception | (?:gpl|general public license) with(?: a| the)? font (?:embedding )?exception
gpl-bison | bison exception | (?:gpl|general public license)(?: 2 0)? with bison exception
gfdl-no-invariant | no invariant sections | with no invariant sections no front cover texts and no back cover texts
mpl-2.0 | terms of the mozilla public | this source code form is subject to the terms of the mozilla public license v 2 0
mpl-2.0 | mozilla org mpl | if a copy of the mpl was not distributed with this file you can obtain one at https? (?:www )?mozilla org mpl 2 0
mpl-1.1 | mozilla public license version 1 1 | the contents of this file are subject to the mozilla public license version 1 1
mpl-incompatible | incompatible with secondary licenses | this source code form is incompatible with secondary licenses
epl-1.0 | eclipse org legal epl v10 | (?:https? )?(?:www )?eclipse org legal epl v10(?: html)?
epl-2.0 | eclipse org legal epl | (?:https? )?(?:www )?eclipse org legal epl(?: v)? ?2 0
edl-1.0 | eclipse distribution license | eclipse distribution license(?: version| v)?(?: 1 0)?
cddl | terms of the common development | subject to the terms of the common development and distribution license
cpal-1.0 | common public attribution | common public attribution license(?: version)?(?: 1 0)?
cpl | common public license,accompanying common public | made available under the terms of the(?: accompanying)? common public license
ipl-1.0 | ibm public license | ibm public license(?: version| v)?(?: 1 0)?
spl-1.0 | sun public license | sun public license(?: version)?(?: 1 0)?
npl-1.1 | netscape public license | netscape public license(?: version)?(?: 1 [01])?
qpl-1.0 | q public license | q public license(?: version)?(?: 1 0)?
eupl-1.2 | licensed under the eupl | licensed under the eupl(?: version| v)? ?1 2(?: or)?
eupl | european union public licence | (?:the )?european union public licen[cs]e
cecill-b | cecill b | cecill b(?: license)?
cecill-c | cecill c | cecill c(?: license)?
artistic | terms of the artistic licen,clarified artistic | under the terms of the artistic licen[cs]e|clarified artistic licen[cs]e
perl | same terms as perl | (?:redistribute|use|distribute) it (?:and or modify it )?under the same terms as perl(?: itself)?
ruby | same terms as ruby,ruby licen | under the same terms as ruby(?: itself)?|(?:the )?ruby licen[cs]e
python | same terms as python | under the same terms as python(?: itself)?
lua | lua licen | (?:the )?lua licen[cs]e
tcl | tcl tk licen,tcl licen | (?:the )?tcl(?: tk)? licen[cs]e
vim | vim licen | (?:the )?vim licen[cs]e
php-3.01 | php net license | (?:https? )?(?:www )?php net license 3 01(?: txt)?
zlib | altered source versions | altered source versions must be plainly marked as such and must not be misrepresented as being the original software
zlib | the origin of this software | the origin of this software must not be misrepresented
zlib | in no event will the authors be held | in no event will the authors be held liable for any damages arising from the use of this software
libpng-2.0 | png reference library license | png reference library license version 2
bzip2 | bzip2 license | bzip2(?: and libbzip2)? license
curl | curl and libcurl | curl and libcurl are licensed
openssl | openssl toolkit | this product includes software developed by the openssl project for use in the openssl toolkit
ssleay | ssleay license,original ssleay,includes cryptographic software | (?:original )?ssleay license|includes cryptographic software written by eric young
boost-1.0 | boost org license | (?:https? )?(?:www )?boost org license 1 0(?: txt)?
boost-1.0 | distributed under the boost | distributed under the boost software license version 1 0
unlicense | unencumbered software | this is free and unencumbered software released into the public domain
unlicense | unlicense org | (?:https? )?unlicense org
cc0-1.0 | cc0 1 0,public domain dedication | cc0 1 0 universal(?: public domain dedication)?|creative commons public domain dedication
cc0-1.0 | publicdomain zero | (?:https? )?creativecommons org publicdomain zero 1 0
cc-pdm-1.0 | publicdomain mark | (?:https? )?creativecommons org publicdomain mark 1 0
cc-by | creativecommons org licenses by | (?:https? )?(?:www )?creativecommons org licenses by [1-4] [05]
cc-by-sa | creativecommons org licenses by sa | (?:https? )?(?:www )?creativecommons org licenses by sa [1-4] [05]
cc-by-nd | creativecommons org licenses by nd | (?:https? )?(?:www )?creativecommons org licenses by nd [1-4] [05]
cc-by-nc | creativecommons org licenses by nc | (?:https? )?(?:www )?creativecommons org licenses by nc [1-4] [05]
cc-by-nc-sa | creativecommons org licenses by nc sa | (?:https? )?(?:www )?creativecommons org licenses by nc sa [1-4] [05]
cc-by-nc-nd | creativecommons org licenses by nc nd | (?:https? )?(?:www )?creativecommons org licenses by nc nd [1-4] [05]
pddl-1.0 | public domain dedication and licen,pddl | open data commons public domain dedication and licen[cs]e|pddl(?: 1 0)?
odc-by-1.0 | open data commons attribution,odc by | open data commons attribution licen[cs]e|odc by(?: 1 0)?
odbl-1.0 | opendatacommons org | (?:https? )?(?:www )?opendatacommons org licenses odbl
ogl-uk | open government licence | open government licence(?: version| v)?(?: [123](?: 0)?)?
etalab-2.0 | licence ouverte,etalab | licence ouverte(?: open licence)?|etalab 2 0
dl-de | datenlizenz deutschland | datenlizenz deutschland (?:namensnennung|zero)(?: version)?(?: 2 0)?
cdla-permissive | community data license | community data license agreement permissive(?: version)?(?: [12] 0)?
cdla-sharing | community data license | community data license agreement sharing(?: version)?(?: 1 0)?
ofl-1.1 | scripts sil org ofl | (?:https? )?scripts sil org ofl
ofl | reserved font name | with reserved font names?
bitstream-vera | bitstream vera | bitstream vera(?: fonts)? (?:copyright|license)
ubuntu-font | ubuntu font licen | ubuntu font licen[cs]e(?: version)?(?: 1 0)?
mulan-2.0 | mulan psl | mulan psl(?: v)? ?2|mulan permissive software license(?: v)? ?2
upl-1.0 | universal permissive license | universal permissive license(?: v| version)? ?(?:1 0)?
ecl-2.0 | educational community license | educational community license(?: version)?(?: [12] 0)?
aladdin | aladdin free public | aladdin free public license
ms-pl | ms pl,microsoft public | ms pl|microsoft public license
ms-rl | ms rl,microsoft reciprocal | ms rl|microsoft reciprocal license
wtfpl | do what the,wtfpl net | you just do what the fuck you want to|(?:https? )?(?:www )?wtfpl net
beerware | you can buy me a beer | you can buy me a beer in return
sspl-1.0 | server side public | server side public license(?: version| v)?(?: 1)?
elastic-2.0 | elastic license | elastic license(?: version)? ?(?:2 0)?
confluent-1.0 | confluent community | confluent community license(?: version)?(?: 1 0)?
redis-source | redis source available | redis source available license(?: v| version)? ?(?:[12] 0)?
bsl-1.1 | change date,mariadb business | mariadb business source license|additional use grant .{1,200}? change date
polyform-nc | polyform noncommercial | polyform noncommercial license(?: 1 0 0)?
polyform-small | polyform small business | polyform small business license(?: 1 0 0)?
commons-clause | commons clause | commons clause(?: license)?(?: condition)?
prosperity | prosperity public license | prosperity public license(?: [23] 0 0)?
parity | parity public license | parity public license(?: [67] 0 0)?
openrail-m | openrail | (?:creativeml )?(?:open ?rail(?: plus plus)?|bigscience openrail)(?: m)?(?: license)?
llama-2 | llama 2 community | llama 2 community license(?: agreement)?
llama-3 | llama 3 community | llama 3(?: [0-9])? community license(?: agreement)?
gemma | gemma terms of use | gemma terms of use
bloom-rail | bigscience rail | bigscience(?: bloom)? rail(?: 1 0)?(?: license)?
json | used for good not evil | (?:the )?software shall be used for good not evil
ncsa | ncsa open source,uiuc | (?:university of illinois )?ncsa open source license
afl-3.0 | licensed under the academic free | licensed under the academic free license version 3 0
osl-3.0 | licensed under the open software | licensed under the open software license version 3 0
w3c | w3c software | w3c software (?:notice and )?(?:document )?license|w3c software and document notice
unicode | unicode license,unicode inc license | unicode(?: inc)? license(?: agreement)?(?: data files and software)?
icu | icu license | icu license
hpnd | historical permission notice | historical permission notice and disclaimer
ntp | ntp license | ntp license
intel | intel open source | intel open source license
nvidia | nvidia software license,nvidia source code | nvidia (?:source code|software) license(?: agreement)?
oracle-bcl | oracle binary code | oracle binary code license(?: agreement)?
proprietary | trade secret | (?:confidential and )?proprietary (?:trade secrets?|information) of
proprietary | unauthorized copying | unauthorized (?:copying|reproduction|distribution|use) of this (?:file|document|software|work)(?: via any medium)? is (?:strictly )?prohibited
proprietary | no part of this | no part of this (?:publication|book|document|work|material) may be reproduced
proprietary | end user licen | end user licen[cs]e agreement
personal-use | personal use only,non commercial use only | for (?:personal|private|non ?commercial|educational|research)(?: and (?:personal|private|non ?commercial|educational|research))? use only
fair-use | fair use | (?:constitutes|considered|under) (?:a )?fair use
public-domain | public domain | (?:this work|this text|it|this file|this software|this image) is (?:hereby )?(?:in|placed in|released into|dedicated to) the public domain
public-domain-us | work of the united states,us government | work of the (?:united states|us|u s)(?: federal)? government
dual | dual licensed | dual licensed under
spdx-or | spdx licen | spdx licen[cs]e identifier [a-z0-9 ]{1,60}? or [a-z0-9 ]{1,30}
spdx-and | spdx licen | spdx licen[cs]e identifier [a-z0-9 ]{1,60}? and [a-z0-9 ]{1,30}
spdx-with | spdx licen | spdx licen[cs]e identifier [a-z0-9 ]{1,60}? with [a-z0-9 ]{1,40}? exception
warranty-disclaimer | as is without warranty | (?:the software|this software|it) is provided as is without warranty of any kind(?: express or implied)?
"""
#: How a license is referred to, from the most to the least certain: priority and frame around it.
_FRAMES = (
    (1, r"(?:(?:licen[cs]ed|released|distributed|available|published|provided) under (?:the )?(?:terms of )?(?:the )?(?:conditions of the )?|(?:subject|according) to (?:the )?(?:terms of )?(?:the )?|spdx licen[cs]e identifier ){r}"),
    (2, r"{r}"),
)


#: What a text before a detection ends with if the detection is negated.
NEGATED = r" (?:not|never|longer|nor) (?:be |been )?(?:(?:licen[cs]ed|released|distributed|available|published|provided) )?(?:under )?(?:the )?(?:terms of )?(?:the )?$"


def sentences() -> list[Rule]:
    """The rules by wording."""
    rows = [[part.strip() for part in line.split(" | ", 2)] for line in _SENTENCES.strip().splitlines()]
    return [Rule(label, keywords.replace(",", "|"), f"(?:{regex})", 1) for label, keywords, regex in rows]


def rules() -> list[Rule]:
    """The signature rules, several hundred, in order: sentences, families with versions, plain names."""
    named = []
    for label, regex, keywords, versions in _NAMES:
        for v in versions:
            named.append((label.format(v=v.replace(" ", ".")), regex.replace("{w}", f"(?:{v})(?: or later| or any later version| only)?"), keywords))
    for code, words in _CC:
        for v in _CC_VERSIONS:
            named.append((f"cc-{code}-{v.replace(' ', '.')}", rf"(?:cc {code.replace('-', ' ')}|creative commons {words})(?: licen[cs]e)?(?: version| v)? ?{v}(?: international| unported| generic)?", "cc by|creative commons"))
        named.append((f"cc-{code}", rf"cc {code.replace('-', ' ')}|creative commons {words}(?: licen[cs]e)?", "cc by|creative commons"))
    framed = [(p, n, f.replace("{r}", f"(?:{r})"), k) for n, r, k in named for p, f in _FRAMES]
    framed += [(p + 1, n, f.replace("{r}", f"(?:{r})"), k) for n, r, k in _PLAIN for p, f in _FRAMES]
    return sentences() + [Rule(n, k, f, p) for p, n, f, k in framed]


def words(text: Column) -> Column:
    """Lower-case words joined by single blanks, with a blank at either end; a blank if none."""
    joined = F.regexp_replace(ascii_lower(F.coalesce(text, F.lit(""))), BETWEEN, " ")
    return F.concat(F.lit(" "), F.trim(joined), F.lit(" "))


def _once(value: Column, use) -> Column:
    """use(value) with the value computed once, also where it is used inside another lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def phrase_starts(joined: Column, phrase: str) -> Column:
    """Word numbers where the phrase's words stand consecutively; overlapping places all count."""
    parts = phrase.split()

    def starts(tokens: Column) -> Column:
        last = F.size(tokens) - len(parts)
        fits = lambda i: F.forall(F.sequence(F.lit(0), F.lit(len(parts) - 1)), lambda k: F.get(tokens, i + k) == F.get(F.array(*[F.lit(p) for p in parts]), k))
        return F.when(last >= 0, F.filter(F.sequence(F.lit(0), last), fits)).otherwise(F.array().cast("array<int>"))

    return _once(F.split(F.trim(joined), " "), starts)


def _table(own: list[Rule]) -> Column:
    """The rules as a column, those with the same keywords together."""
    groups: dict[str, list[Column]] = {}
    for i, r in enumerate(own):
        row = F.struct(F.lit(r.label).alias("label"), F.lit(rf"(?<= )(?:{r.regex})(?= )").alias("regex"), F.lit(r.priority).alias("priority"), F.lit(i).alias("order"))
        groups.setdefault(r.keyword, []).append(row)
    return F.array(*[F.struct(F.array(*[F.lit(" " + k) for k in keyword.split("|")]).alias("keywords"), F.array(*rows).alias("rules")) for keyword, rows in groups.items()])


def gate(own: list[Rule]) -> str:
    """A regular expression on lower-case text that finds any keyword of the rules or base phrase where words() would show it."""
    phrases = {k for r in own for k in r.keyword.split("|")} | {p for p, _ in BASE}
    # Branches by first letter, a few letters behind a look ahead, as every word of a text tries them.
    by_letter: dict[str, list[str]] = {}
    for p in sorted(phrases):
        by_letter.setdefault(p[0], []).append(BETWEEN.join(re.escape(w) for w in p.split())[len(re.escape(p[0])) :])
    letters = sorted(by_letter)
    few = [letters[i : i + 5] for i in range(0, len(letters), 5)]
    branch = lambda c: re.escape(c) + f"(?:{'|'.join(by_letter[c])})"
    return f"(?:^|{BETWEEN.removesuffix('+')})(?:" + "|".join(f"(?=[{''.join(f)}])(?:{'|'.join(map(branch, f))})" for f in few) + ")"


def _detections(joined: Column, table: Column) -> Column:
    """array<struct<first, last, priority, order, label>> (word numbers) of all rules that match."""
    # The keyword prefilter: rules whose keywords are not there are not tried.
    groups = F.filter(table, lambda g: F.exists(g["keywords"], lambda k: F.contains(joined, k)))
    candidates = F.flatten(F.transform(groups, lambda g: g["rules"]))

    def places(r: Column) -> Column:
        blanks = lambda x: F.length(x) - F.length(F.replace(x, F.lit(" ")))
        both = F.struct(F.split(joined, r["regex"]).alias("parts"), F.regexp_extract_all(joined, r["regex"], F.lit(0)).alias("found"))

        def numbered(s: Column) -> Column:
            # The words before a match: those of the parts between the matches, and of earlier matches.
            none = F.array().cast("array<struct<first:int,last:int,no:boolean>>")
            state = F.struct(F.lit(0).alias("n"), none.alias("done"))

            def step(t: Column, i: Column) -> Column:
                first = t["n"] + blanks(F.get(s["parts"], i))
                last = first + blanks(F.get(s["found"], i))
                return F.struct(last.alias("n"), F.array_append(t["done"], F.struct((first - 1).alias("first"), (last - 1).alias("last"), F.get(s["parts"], i).rlike(NEGATED).alias("no"))).alias("done"))

            n = F.size(s["found"])
            return F.when(n > 0, F.aggregate(F.sequence(F.lit(0), n - 1), state, step)["done"]).otherwise(none)

        found = F.filter(_once(both, numbered), lambda x: ~x["no"])
        return F.transform(found, lambda x: F.struct(x["first"].alias("first"), x["last"].alias("last"), r["priority"].alias("priority"), r["order"].alias("order"), r["label"].alias("label")))

    return F.flatten(F.transform(candidates, places))


def _kept(found: Column) -> Column:
    """Detections that no better one contains, in order of their first words.

    In order of first word, longest first, then priority and rule, every better one stands before;
    so a detection goes if an earlier one of its priority or a better one ends no earlier.
    """
    place = lambda d: F.struct(d["first"].alias("first"), (-d["last"]).alias("back"), d["priority"].alias("priority"), d["order"].alias("order"), d["label"].alias("label"))
    ends = F.array_repeat(F.lit(-1), PRIORITIES + 1)
    state = F.struct(ends.alias("ends"), F.array().cast("array<struct<first:int,last:int,priority:int,order:int,label:string>>").alias("kept"))

    def step(s: Column, d: Column) -> Column:
        last = -d["back"]
        own = F.struct(d["first"].alias("first"), last.alias("last"), d["priority"].alias("priority"), d["order"].alias("order"), d["label"].alias("label"))
        later = F.transform(s["ends"], lambda e, p: F.when((p >= d["priority"]) & (last > e), last).otherwise(e))
        return F.struct(later.alias("ends"), F.when(F.get(s["ends"], d["priority"]) >= last, s["kept"]).otherwise(F.array_append(s["kept"], own)).alias("kept"))

    return F.aggregate(F.array_sort(F.transform(found, place)), state, step)["kept"]


def scan(docs: DataFrame, own: list[Rule] | None = None) -> DataFrame:
    """doc_id, n_words, base (starts by phrase), detections: of every whole text."""
    own = rules() if own is None else own
    table = _table(own)
    text = F.coalesce(F.col("text"), F.lit(""))
    # First gate: texts without a keyword or base phrase are counted and never rewritten.
    open_to = F.lower(text).rlike(gate(own))
    counted = docs.select(F.col("doc_id").cast("long"), F.regexp_count(text, F.lit(WORD_ANY_CASE)).cast("long").alias("n_words"), F.when(open_to, words(text)).alias("joined"))
    base = [F.when(F.contains(F.col("joined"), F.lit(f" {p} ")), phrase_starts(F.col("joined"), p)).otherwise(F.array().cast("array<int>")).alias(f"b{i}") for i, (p, _) in enumerate(BASE)]
    detected = F.when(F.col("joined").isNotNull(), _once(_detections(F.col("joined"), table), _kept))
    return counted.select("doc_id", "n_words", F.array(*base).alias("base"), detected.alias("detections"))


def _words_from(n: int) -> Callable[[Column], Column]:
    """The numbers of the n words from a place on."""
    return lambda s: F.sequence(s, s + (n - 1))


def license_labels(docs: DataFrame) -> DataFrame:
    """Per document: n_words, n_base, first_word, last_word, base_labels, labels, score."""
    found = scan(docs)
    places = F.flatten("base")
    base = F.array_compact(F.array(*[F.when(F.size(F.col("base")[i]) > 0, label) for i, (_, label) in enumerate(BASE)]))
    every = F.array_union(base, F.coalesce(F.transform("detections", lambda d: d["label"]), F.array().cast("array<string>")))
    covered = F.array_distinct(F.concat(
        *[F.flatten(F.transform(F.col("base")[i], _words_from(len(p.split())))) for i, (p, _) in enumerate(BASE)],
        F.coalesce(F.flatten(F.transform("detections", lambda d: F.sequence(d["first"], d["last"]))), F.array().cast("array<int>")),
    ))
    listed = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    return found.select(
        "doc_id", "n_words", F.size(places).cast("long").alias("n_base"), F.array_min(places).cast("long").alias("first_word"), F.array_max(places).cast("long").alias("last_word"),
        listed(base).alias("base_labels"), listed(every).alias("labels"), F.when(F.col("n_words") > 0, F.size(covered) / F.col("n_words")).otherwise(0.0).alias("score"),
    )
