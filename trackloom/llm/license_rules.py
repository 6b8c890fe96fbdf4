"""Signature rules of the license scan: texts of rules, over lower-cased words joined by single blanks (punctuation is gone: "2.0" is "2 0").

``FAMILIES`` are names, each scanned for in the forms of ``FORMS``. ``SIGNATURES`` are single expressions written by hand for headers, clauses, titles,
exceptions, notices and addresses. Each rule names its gate words: a match holds one of them, so elsewhere the rule isn't tried.
"""

#: label; gate words; name; versions it is named with; SPDX words.
FAMILIES = [
    ("mit", "mit expat x11", "mit|expat|x11", "", "mit"),
    ("apache", "apache", "apache(?: software)?", "1 0|1 1|2|2 0", "apache"),
    ("gpl", "gpl public", "gnu general public|general public|gnu gpl|gpl", "1|2|3|1 0|2 0|3 0", "gpl"),
    ("lgpl", "lgpl lesser library", "gnu lesser general public|lesser general public|gnu library general public|gnu lgpl|lgpl", "2|2 0|2 1|3|3 0", "lgpl"),
    ("agpl", "agpl affero", "gnu affero general public|affero general public|gnu agpl|agpl", "1|3|1 0|3 0", "agpl"),
    ("gfdl", "gfdl documentation", "gnu free documentation|gfdl", "1 1|1 2|1 3", "gfdl"),
    ("bsd", "bsd", "(?:(?:[0234] clause|simplified|new|revised|original|modified) )?bsd(?: [0234] clause)?", "", "bsd(?: [0234] clause)?"),
    ("mpl", "mpl mozilla", "mozilla public|mpl", "1 0|1 1|2 0", "mpl"),
    ("epl", "epl eclipse", "eclipse public|epl", "1 0|2 0", "epl"),
    ("edl", "edl eclipse", "eclipse distribution|edl", "1 0", "edl"),
    ("cddl", "cddl", "common development and distribution|cddl", "1 0|1 1", "cddl"),
    ("cpl", "cpl", "cpl", "1 0", "cpl"),
    ("cpal", "cpal attribution", "common public attribution|cpal", "1 0", "cpal"),
    ("eupl", "eupl european", "european union public|eupl", "1 0|1 1|1 2", "eupl"),
    ("isc", "isc consortium", "isc|internet systems consortium", "", "isc"),
    ("zlib", "zlib", "zlib(?: libpng)?", "", "zlib"),
    ("boost", "boost bsl", "boost software", "1 0", "bsl"),
    ("artistic", "artistic", "(?:perl |clarified )?artistic", "1 0|2 0", "artistic"),
    ("python", "python psf", "python software foundation|psf", "2|2 0", "psf"),
    ("ruby", "ruby", "ruby", "", "ruby"),
    ("php", "php", "php", "3 0|3 01", "php"),
    ("zope", "zope zpl", "zope public|zpl", "1 1|2 0|2 1", "zpl"),
    ("osl", "osl", "osl", "1 0|2 0|2 1|3 0", "osl"),
    ("afl", "afl academic", "academic free|afl", "1 1|1 2|2 0|2 1|3 0", "afl"),
    ("upl", "upl permissive", "universal permissive|upl", "1 0", "upl"),
    ("ncsa", "ncsa illinois", "university of illinois(?: ncsa)? open source|ncsa open source", "", "ncsa"),
    ("ms_pl", "microsoft ms", "microsoft public|ms pl", "", "ms pl"),
    ("ms_rl", "microsoft ms", "microsoft reciprocal|ms rl", "", "ms rl"),
    ("wtfpl", "wtfpl", "wtfpl", "1|2", "wtfpl"),
    ("unlicense", "unlicense", "unlicense", "", "unlicense"),
    ("cc0", "cc0", "cc0", "1 0", "cc0"),
    ("cc_by", "commons cc", "creative commons attribution|cc by", "2 0|2 5|3 0|4 0", "cc by"),
    ("cc_by_sa", "commons cc", "creative commons attribution share ?alike|cc by sa", "2 0|2 5|3 0|4 0", "cc by sa"),
    ("cc_by_nc", "commons cc", "creative commons attribution non ?commercial|cc by nc", "2 0|2 5|3 0|4 0", "cc by nc"),
    ("cc_by_nd", "commons cc", "creative commons attribution no ?deriv(?:ative)?s|cc by nd", "2 0|2 5|3 0|4 0", "cc by nd"),
    ("cc_by_nc_sa", "commons cc", "creative commons attribution non ?commercial share ?alike|cc by nc sa", "2 0|2 5|3 0|4 0", "cc by nc sa"),
    ("odbl", "odbl database", "open database|odbl", "1 0", "odbl"),
    ("ofl", "ofl font", "sil open font|open font|ofl", "1 0|1 1", "ofl"),
    ("busl", "busl business", "business source|busl", "1 0|1 1", "busl"),
    ("sspl", "sspl server", "server side public|sspl", "1", "sspl"),
    ("elastic", "elastic", "elastic", "1|2|2 0", "elastic"),
    ("openssl", "openssl", "openssl(?: and ssleay)?", "", "openssl"),
    ("postgresql", "postgresql", "postgresql", "", "postgresql"),
    ("apsl", "apsl apple", "apple public source|apsl", "1 0|1 1|1 2|2 0", "apsl"),
    ("lppl", "lppl latex", "latex project public|lppl", "1 0|1 1|1 2|1 3", "lppl"),
    ("cecill", "cecill", "cecill", "1 0|1 1|2 0|2 1", "cecill"),
    ("openrail", "openrail responsible", "open responsible ai|openrail(?: m)?", "", "openrail"),
]
#: Forms of naming a license: suffix; pattern with {n} name, {v} version, {s} SPDX words; priority; confidence.
FORMS = [
    ("spdx", r"spdx license identifier (?:{s})(?: (?:{v}))?(?: only| or later)?", 60, 1.0),
    ("under", r"(?:licen[sc]ed|released|distributed|available|published|provided) under (?:the )?(?:terms of (?:the )?)?(?:{n})(?: licen[sc]e)?(?: (?:version |v)?(?:{v}))?", 50, 0.98),
    ("version", r"(?:{n}) licen[sc]e(?: agreement)? (?:version |v)(?:{v})", 40, 0.95),
    ("subject", r"subject to the (?:terms (?:and conditions )?of the )?(?:{n}) licen[sc]e", 30, 0.9),
    ("named", r"(?:the )?(?:{n}) licen[sc]e", 20, 0.8),
]
#: label; priority; confidence; gate words; pattern.
SIGNATURES = r"""
mit | 70 | .97 | hereby | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit | 65 | .90 | sublicense | without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software
mit | 65 | .90 | portions | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit | 45 | .70 | noninfringement | including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement
mit | 45 | .70 | tort | whether in an action of contract tort or otherwise arising from out of or in connection with the software
mit | 55 | .95 | mit | license mit
mit | 55 | .95 | mit | opensource org licen[sc]es mit(?: license)?(?: php| html)?
mit | 55 | .90 | mit | licensed under mit
mit | 55 | .90 | mit | mit style licen[sc]e
mit_0 | 60 | .95 | attribution | mit no attribution(?: licen[sc]e)?
mit_modern | 60 | .90 | variant | mit licen[sc]e modern variant
x11 | 60 | .90 | consortium | except as contained in this notice the name of the x consortium shall not be used in advertising
isc | 70 | .97 | fee | permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted
isc | 60 | .90 | disclaims | the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness
isc | 45 | .70 | tortious | whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance
isc | 55 | .95 | isc | opensource org licen[sc]es isc
bsd | 70 | .95 | redistribution | redistribution and use in source and binary forms with or without modification are permitted(?: provided that the following conditions are met)?
bsd | 60 | .90 | redistributions | redistributions of source code must retain the(?: above)? copyright notice this list of conditions and the following disclaimer
bsd | 60 | .90 | redistributions | redistributions in binary form must reproduce the(?: above)? copyright notice this list of conditions and the following disclaimer in the documentation
bsd_3 | 65 | .95 | endorse | (?:neither the name of [^ ]+(?: [^ ]+){0,8} )?nor the names of its contributors may be used to endorse or promote products derived from this software
bsd_4 | 68 | .97 | advertising | all advertising materials mentioning features or use of this software must display the following acknowledgement
bsd_patent | 66 | .95 | patent | bsd(?: 2 clause)? plus patent licen[sc]e
bsd_clear | 66 | .95 | patent | no express or implied licen[sc]es to any party s patent rights are granted by this licen[sc]e
bsd | 45 | .70 | incidental | in no event shall the (?:regents|authors?|copyright holders?)(?: or contributors)? be liable for any direct indirect incidental special
bsd | 55 | .95 | bsd | opensource org licen[sc]es bsd [^ ]+
bsd_1 | 60 | .90 | bsd | bsd 1 clause licen[sc]e
bsd_2 | 60 | .95 | bsd | bsd 2 clause(?: simplified)?(?: licen[sc]e)?
bsd_3 | 60 | .95 | bsd | bsd 3 clause(?: new| revised)?(?: licen[sc]e)?
bsd_0 | 62 | .95 | 0bsd | 0bsd
bsd_protection | 60 | .90 | protection | bsd protection licen[sc]e
apache | 70 | .97 | compliance | you may not use this file except in compliance with the licen[sc]e
apache | 65 | .90 | obtain | you may obtain a copy of the licen[sc]e at(?: http[s]?)? www apache org licen[sc]es licen[sc]e 2 0
apache | 60 | .90 | applicable | unless required by applicable law or agreed to in writing software distributed under the licen[sc]e is distributed on an as is basis
apache | 60 | .95 | contributor | subject to the terms and conditions of this licen[sc]e each contributor hereby grants to you a perpetual worldwide non exclusive
apache | 55 | .95 | apache | apache 2 0
apache | 55 | .95 | apache | www apache org licen[sc]es(?: licen[sc]e [12] [01])?
apache_1_1 | 66 | .95 | apache | this product includes software developed by the apache (?:software foundation|group)
apache_1_0 | 66 | .90 | apache | redistributions of any form whatsoever must retain the following acknowledgment this product includes software developed by the apache group
apache_mit | 75 | .95 | apache | (?:dual )?licensed under (?:either of )?(?:the )?apache (?:licen[sc]e )?(?:version )?2 0 (?:or|and) (?:the )?mit(?: licen[sc]e)?
apache_mit | 75 | .95 | apache | mit or apache 2 0
apache_llvm | 72 | .97 | llvm | apache 2 0 with llvm exceptions?
gpl | 70 | .95 | redistribute | this program is free software you can redistribute it and or modify it under the terms of the gnu general public licen[sc]e
gpl_or_later | 66 | .90 | later | either version [123] of the licen[sc]e or(?: at your option)? any later version
gpl | 55 | .85 | merchantability | without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public licen[sc]e for more details
gpl | 55 | .85 | received | you should have received a copy of the gnu general public licen[sc]e along with this program
gpl | 60 | .90 | freedom | the licen[sc]es for most software are designed to take away your freedom to share and change it
gpl_3 | 62 | .95 | copyleft | the gnu general public licen[sc]e is a free copyleft licen[sc]e for software and other kinds of works
gpl | 62 | .95 | june | gnu general public licen[sc]e version 2 june 1991
gpl_3 | 63 | .95 | gnu | gnu general public licen[sc]e version 3 29 june 2007
gpl_2_only | 63 | .95 | gpl | gpl 2 0 only
gpl_2_or_later | 63 | .95 | gpl | gpl 2 0 or later
gpl_3_only | 63 | .95 | gpl | gpl 3 0 only
gpl_3_or_later | 63 | .95 | gpl | gpl 3 0 or later
gpl | 55 | .90 | gnu | www gnu org (?:copyleft|licen[sc]es) gpl(?: [^ ]+)?
gpl | 50 | .85 | gplv2 | gplv2
gpl_3 | 50 | .85 | gplv3 | gplv3
gpl_classpath | 72 | .97 | classpath | (?:with|gnu) classpath exception(?: 2 0)?
gpl_linking | 72 | .90 | linking | linking this library statically or dynamically with other modules is making a combined work based on this library
gpl_bison | 72 | .90 | bison | as a special exception you may create a larger work that contains part or all of the bison parser skeleton
gpl_autoconf | 72 | .90 | autoconf | this exception applies to the configure script output of autoconf
gpl_gcc | 72 | .95 | gcc | gcc runtime library exception(?: version 3 1)?
gpl_font | 72 | .90 | font | as a special exception if you create a document which uses this font and embed this font
gpl_syscall | 72 | .95 | syscall | linux syscall note
lgpl | 70 | .95 | lesser | this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public licen[sc]e
lgpl | 62 | .95 | lesser | gnu lesser general public licen[sc]e version (?:2 1 february 1999|3 29 june 2007)
lgpl | 62 | .95 | library | gnu library general public licen[sc]e version 2 june 1991
lgpl | 55 | .85 | lesser | you should have received a copy of the gnu lesser general public licen[sc]e along with this (?:library|program)
lgpl | 63 | .95 | lgpl | lgpl (?:2 1|3 0|2 0) (?:only|or later)
lgpl | 55 | .90 | gnu | www gnu org (?:copyleft|licen[sc]es) (?:lgpl|lesser)(?: [^ ]+)?
lgpl | 50 | .85 | lgplv2 | lgplv2(?: 1)?
lgpl | 50 | .85 | lgplv3 | lgplv3
agpl | 70 | .95 | affero | this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public licen[sc]e
agpl | 62 | .95 | affero | gnu affero general public licen[sc]e version 3 19 november 2007
agpl | 62 | .90 | network | must prominently offer all users interacting with it remotely through a computer network
agpl | 63 | .95 | agpl | agpl 3 0 (?:only|or later)
agpl | 50 | .85 | agplv3 | agplv3
gfdl | 66 | .95 | invariant | with no invariant sections no front cover texts and no back cover texts
gfdl | 62 | .95 | documentation | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[sc]e
mpl | 70 | .97 | mozilla | this source code form is subject to the terms of the mozilla public licen[sc]e(?: v 2 0)?
mpl_1_1 | 68 | .95 | mozilla | the contents of this file are subject to the mozilla public licen[sc]e version 1 1
mpl | 55 | .90 | mozilla | (?:www )?mozilla org mpl(?: [12] [01])?
mpl | 66 | .95 | incompatible | this source code form is incompatible with secondary licen[sc]es
mpl_tri | 74 | .95 | mpl | mpl 1 1 gpl 2 0 lgpl 2 1
epl | 70 | .95 | eclipse | all rights reserved this program and the accompanying materials are made available under the terms of the eclipse public licen[sc]e
epl | 65 | .95 | accompanying | the accompanying materials are made available under the terms of the eclipse (?:public licen[sc]e|distribution licen[sc]e)
epl | 55 | .90 | eclipse | www eclipse org (?:legal|org documents) epl(?: [^ ]+)?
cpl | 55 | .90 | common | common public licen[sc]e(?: version| v)? 1 0
ibm_pl | 55 | .90 | ibm | ibm public licen[sc]e(?: version 1 0)?
cddl | 68 | .95 | development | the contents of this file are subject to the terms of the common development and distribution licen[sc]e
cddl | 62 | .90 | development | common development and distribution licen[sc]e(?: cddl)?(?: version 1 [01])?
eupl | 66 | .95 | eupl | licensed under the eupl
eupl | 66 | .95 | european | licensed under the european union public licen[sc]e
artistic | 66 | .90 | artistic | the terms of the perl artistic licen[sc]e
perl | 68 | .95 | perl | (?:you can redistribute it and or modify it |licensed )?under the same terms as perl(?: 5)?(?: itself)?
python | 66 | .95 | python | python software foundation licen[sc]e version 2
python | 60 | .90 | cwi | cwi licen[sc]e agreement for python
python | 60 | .90 | beopen | beopen python open source licen[sc]e agreement
zlib | 70 | .95 | express | this software is provided as is without any express or implied warranty in no event will the authors be held liable
zlib | 65 | .90 | misrepresented | the origin of this software must not be misrepresented you must not claim that you wrote the original software
zlib | 60 | .90 | altered | altered source versions must be plainly marked as such
libpng | 62 | .90 | libpng | libpng(?: version 2)? licen[sc]e
boost | 70 | .97 | organization | permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation
boost | 60 | .95 | boost | distributed under the boost software licen[sc]e(?: version 1 0)?
boost | 55 | .90 | boost | www boost org licen[sc]e 1 0 txt
unlicense | 70 | .97 | unencumbered | this is free and unencumbered software released into the public domain
unlicense | 60 | .90 | unlicense | (?:https? )?unlicense org
cc0 | 66 | .95 | cc0 | cc0 1 0 universal(?: public domain dedication)?
cc0 | 64 | .95 | waived | has waived all copyright and related or neighboring rights
cc_by | 62 | .95 | creativecommons | creativecommons org licen[sc]es by(?: [1234] [05])?
cc_by_sa | 63 | .95 | creativecommons | creativecommons org licen[sc]es by sa(?: [1234] [05])?
cc_by_nc | 63 | .95 | creativecommons | creativecommons org licen[sc]es by nc(?: [1234] [05])?
cc_by_nd | 63 | .95 | creativecommons | creativecommons org licen[sc]es by nd(?: [1234] [05])?
cc_by_nc_sa | 64 | .95 | creativecommons | creativecommons org licen[sc]es by nc sa(?: [1234] [05])?
cc_by_nc_nd | 64 | .95 | creativecommons | creativecommons org licen[sc]es by nc nd(?: [1234] [05])?
cc0 | 63 | .95 | creativecommons | creativecommons org publicdomain zero(?: 1 0)?
public_domain | 62 | .90 | creativecommons | creativecommons org publicdomain mark(?: 1 0)?
cc_by | 60 | .90 | commons | creative commons attribution(?: [1234] [05])? international(?: licen[sc]e)?
cc_by_sa | 61 | .90 | commons | creative commons attribution share ?alike(?: [1234] [05])? (?:international|unported)(?: licen[sc]e)?
public_domain | 50 | .85 | domain | (?:released|placed|dedicated|donated) (?:in|into|to) the public domain
public_domain | 45 | .75 | domain | this (?:work|file|code|document|software) is (?:in|part of) the public domain
public_domain | 55 | .90 | government | (?:is )?a work of the united states government
sqlite | 66 | .95 | forgiveness | may you do good and not evil may you find forgiveness for yourself and forgive others
beerware | 66 | .95 | beer beerware | (?:the )?beer ?ware licen[sc]e
beerware | 64 | .95 | beer | if we meet some day and you think this stuff is worth it you can buy me a beer
json | 66 | .95 | evil | the software shall be used for good not evil
wtfpl | 66 | .95 | fuck | do what the fuck you want to public licen[sc]e
ms_pl | 62 | .90 | governs | this licen[sc]e governs use of the accompanying software if you use the software you accept this licen[sc]e
openssl | 66 | .95 | openssl | this product includes software developed by the openssl project
ssleay | 66 | .95 | ssl | this (?:package|library) is an ssl implementation written by eric young
ftl | 64 | .90 | freetype | (?:the )?freetype project licen[sc]e
ijg | 64 | .90 | jpeg | this software is based in part on the work of the independent jpeg group
curl | 60 | .90 | curl | curl and libcurl are (?:licensed|distributed) under
vim | 60 | .90 | vim | vim is charityware
tcl | 64 | .90 | tcl | tcl tk licen[sc]e
unicode | 64 | .90 | unicode | unicode (?:inc )?licen[sc]e agreement data files and software
w3c | 64 | .90 | w3c | w3c software(?: and document)? notice and licen[sc]e
ofl | 66 | .95 | sil | this font software is licensed under the sil open font licen[sc]e(?: version 1 1)?
ofl | 60 | .90 | reserved | with reserved font name
odbl | 60 | .90 | opendatacommons | opendatacommons org licen[sc]es odbl(?: 1 0)?
odc_by | 60 | .90 | opendatacommons | opendatacommons org licen[sc]es by(?: 1 0)?
pddl | 60 | .90 | opendatacommons | opendatacommons org licen[sc]es pddl(?: 1 0)?
ogl_uk | 62 | .90 | information | contains public sector information licensed under the open government licen[sc]e(?: v[123] 0)?
busl | 64 | .95 | licensor | licensor licensed work additional use grant change date change licen[sc]e
sspl | 64 | .95 | side | server side public licen[sc]e(?: sspl)?
elastic | 62 | .90 | hosted | you may not provide the software to third parties as a hosted or managed service
commons_clause | 66 | .95 | clause | commons clause(?: licen[sc]e condition v1 0)?
polyform | 62 | .90 | polyform | polyform (?:noncommercial|small business|shield|strict|perimeter|internal use|free trial)(?: licen[sc]e)?(?: 1 0 0)?
parity | 60 | .85 | parity | (?:the )?parity public licen[sc]e
llama | 62 | .90 | llama | llama (?:[23] (?:[123] )?)?community licen[sc]e(?: agreement)?
gemma | 62 | .90 | gemma | gemma terms of use
openrail | 62 | .90 | creativeml bigscience bigcode | (?:creativeml|bigscience|bigcode) (?:open )?(?:rail|openrail)(?: m)?(?: licen[sc]e)?
commercial | 35 | .60 | commercial | for non ?commercial use only
commercial | 35 | .60 | academic | for academic(?: research)? use only
research | 35 | .60 | research | for research purposes only
evaluation | 35 | .60 | evaluation | for (?:internal )?evaluation purposes only
proprietary | 8 | .40 | confidential | (?:proprietary and confidential|confidential and proprietary)
proprietary | 8 | .40 | unauthorized | unauthorized copying of this file via any medium is strictly prohibited
proprietary | 8 | .40 | trade | contains (?:proprietary|confidential) information and trade secrets
proprietary | 5 | .30 | reserved | all rights reserved
proprietary | 8 | .40 | user | end user licen[sc]e agreement(?: eula)?
proprietary | 8 | .35 | copy modify sublicense redistribute | you may not (?:copy|modify|sublicense|redistribute)(?: or [^ ]+)? the software
copyright | 5 | .30 | copyright | copyright (?:c )?(?:19|20)[0-9]{2}(?: (?:19|20)[0-9]{2})?
copyleft | 10 | .35 | copyleft | copyleft all wrongs reserved
"""
