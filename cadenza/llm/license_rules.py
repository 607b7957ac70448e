"""Licence signatures: ``label | priority | keyword | pattern``, one rule a line.

Patterns are read over normalised words with one space between (``GPL-3.0`` is ``gpl 3 0``).
A rule is tried only on texts that hold its keyword, which is a word of all its matches.  Names and versions are fixed values.
"""

RULES = r"""
apache-2.0 | 90 | apache | apache license version 2( 0)?
apache-2.0 | 88 | apache | apache 2( 0)?( licen[sc]ed?)?
apache-2.0 | 92 | apache | licensed under the apache license version 2 0
apache-2.0 | 95 | spdx | spdx license identifier apache 2 0
apache-2.0 | 91 | apache | apache org licenses license 2 0
apache-1.1 | 90 | apache | apache (software )?license version 1 1
apache-1.1 | 95 | spdx | spdx license identifier apache 1 1
apache-1.0 | 90 | apache | apache (software )?license version 1 0
apache | 40 | apache | apache (software )?licen[sc]e
mit | 80 | mit | (the )?mit licen[sc]e
mit | 85 | mit | released under the mit licen[sc]e
mit | 85 | mit | licensed under the mit licen[sc]e
mit | 95 | spdx | spdx license identifier mit
mit | 82 | mit | opensource org licenses mit
mit | 84 | hereby | permission is hereby granted free of charge to any person obtaining a copy( of this software)?
mit-0 | 90 | mit | mit no attribution
mit-0 | 95 | spdx | spdx license identifier mit 0
x11 | 80 | x11 | (the )?x11 licen[sc]e
x11 | 95 | spdx | spdx license identifier x11
expat | 80 | expat | expat licen[sc]e
isc | 80 | isc | (the )?isc licen[sc]e
isc | 95 | spdx | spdx license identifier isc
isc | 84 | copy | permission to use copy modify and or distribute this software for any purpose
bsd-2-clause | 90 | bsd | (bsd 2 clause|2 clause bsd)( licen[sc]e)?
bsd-2-clause | 95 | spdx | spdx license identifier bsd 2 clause
bsd-2-clause | 88 | simplified | simplified bsd( licen[sc]e)?
bsd-2-clause | 88 | freebsd | freebsd licen[sc]e
bsd-3-clause | 90 | bsd | (bsd 3 clause|3 clause bsd)( licen[sc]e)?
bsd-3-clause | 95 | spdx | spdx license identifier bsd 3 clause
bsd-3-clause | 88 | revised | revised bsd( licen[sc]e)?
bsd-3-clause | 88 | bsd | (new|modified) bsd( licen[sc]e)?
bsd-4-clause | 90 | bsd | (bsd 4 clause|4 clause bsd)( licen[sc]e)?
bsd-4-clause | 95 | spdx | spdx license identifier bsd 4 clause
bsd-0-clause | 90 | bsd | (bsd zero clause|zero clause bsd)( licen[sc]e)?
bsd-0-clause | 90 | 0bsd | 0bsd( licen[sc]e)?
bsd-0-clause | 95 | 0bsd | spdx license identifier 0bsd
bsd | 45 | bsd | bsd( style)? licen[sc]e
bsd | 60 | redistribution | redistribution and use in source and binary forms with or without modification
gpl-3.0 | 90 | gpl | (gnu )?gpl (v|version )?3( 0)?
gpl-3.0 | 90 | gplv3 | (gnu )?gplv3
gpl-3.0 | 92 | gnu | gnu general public licen[sc]e (v|version )?3( 0)?
gpl-3.0 | 93 | gnu | gnu general public licen[sc]e as published by the free software foundation (either )?version 3
gpl-3.0-only | 96 | spdx | spdx license identifier gpl 3 0 only
gpl-3.0-or-later | 96 | spdx | spdx license identifier gpl 3 0 or later
gpl-3.0-or-later | 94 | later | (gnu )?gpl (v|version )?3( 0)? or( any)? later( version)?
gpl-2.0 | 90 | gpl | (gnu )?gpl (v|version )?2( 0)?
gpl-2.0 | 90 | gplv2 | (gnu )?gplv2
gpl-2.0 | 92 | gnu | gnu general public licen[sc]e (v|version )?2( 0)?
gpl-2.0 | 93 | gnu | gnu general public licen[sc]e as published by the free software foundation (either )?version 2
gpl-2.0-only | 96 | spdx | spdx license identifier gpl 2 0 only
gpl-2.0-or-later | 96 | spdx | spdx license identifier gpl 2 0 or later
gpl-2.0-or-later | 94 | later | (gnu )?gpl (v|version )?2( 0)? or( any)? later( version)?
gpl-1.0 | 92 | gnu | gnu general public licen[sc]e (v|version )?1( 0)?
gpl-1.0 | 95 | spdx | spdx license identifier gpl 1 0( only| or later)?
gpl | 40 | gnu | gnu gpl
gpl-exception | 90 | classpath | classpath exception
gpl-exception | 90 | gcc | gcc runtime library exception
lgpl-2.0 | 92 | lgpl | (gnu )?lgpl (v|version )?2 0
lgpl-2.0 | 93 | library | gnu library general public licen[sc]e( version 2( 0)?)?
lgpl-2.1 | 92 | lgpl | (gnu )?lgpl (v|version )?2 1
lgpl-2.1 | 93 | lesser | gnu lesser general public licen[sc]e (v|version )?2 1
lgpl-2.1 | 96 | spdx | spdx license identifier lgpl 2 1( only| or later)?
lgpl-3.0 | 92 | lgpl | (gnu )?lgpl (v|version )?3( 0)?
lgpl-3.0 | 92 | lgplv3 | (gnu )?lgplv3
lgpl-3.0 | 93 | lesser | gnu lesser general public licen[sc]e (v|version )?3( 0)?
lgpl-3.0 | 96 | spdx | spdx license identifier lgpl 3 0( only| or later)?
lgpl | 60 | lesser | (gnu )?lesser general public licen[sc]e
lgpl | 45 | lgpl | (gnu )?lgpl
agpl-3.0 | 92 | agpl | (gnu )?agpl (v|version )?3( 0)?
agpl-3.0 | 92 | agplv3 | (gnu )?agplv3
agpl-3.0 | 93 | affero | gnu affero general public licen[sc]e( version 3( 0)?)?
agpl-3.0 | 96 | spdx | spdx license identifier agpl 3 0( only| or later)?
agpl-1.0 | 90 | affero | affero general public licen[sc]e version 1
agpl | 45 | agpl | (gnu )?agpl
gfdl-1.3 | 90 | documentation | gnu free documentation licen[sc]e version 1 3
gfdl-1.2 | 90 | documentation | gnu free documentation licen[sc]e version 1 2
gfdl | 60 | documentation | gnu free documentation licen[sc]e
gfdl | 60 | gfdl | (gnu )?gfdl
gfdl-1.3 | 95 | spdx | spdx license identifier gfdl 1 3( only| or later)?
mpl-2.0 | 90 | mozilla | mozilla public licen[sc]e (v|version )?2( 0)?
mpl-2.0 | 90 | mpl | mpl (v|version )?2( 0)?
mpl-2.0 | 95 | spdx | spdx license identifier mpl 2 0
mpl-1.1 | 90 | mozilla | mozilla public licen[sc]e (v|version )?1 1
mpl-1.1 | 90 | mpl | mpl (v|version )?1 1
mpl-1.1 | 95 | spdx | spdx license identifier mpl 1 1
mpl-1.0 | 90 | mozilla | mozilla public licen[sc]e (v|version )?1 0
mpl | 50 | mozilla | mozilla public licen[sc]e
epl-2.0 | 90 | eclipse | eclipse public licen[sc]e (v|version )?2( 0)?
epl-2.0 | 95 | spdx | spdx license identifier epl 2 0
epl-1.0 | 90 | eclipse | eclipse public licen[sc]e (v|version )?1( 0)?
epl-1.0 | 95 | spdx | spdx license identifier epl 1 0
epl | 50 | eclipse | eclipse public licen[sc]e
edl-1.0 | 80 | eclipse | eclipse distribution licen[sc]e
cddl-1.0 | 90 | cddl | cddl (v|version )?1 0
cddl-1.1 | 90 | cddl | cddl (v|version )?1 1
cddl-1.0 | 90 | common | common development and distribution licen[sc]e (v|version )?1 0
cddl | 60 | common | common development and distribution licen[sc]e
cddl | 45 | cddl | cddl
cpl-1.0 | 80 | common | common public licen[sc]e( version 1 0)?
ipl-1.0 | 80 | ibm | ibm public licen[sc]e( version 1 0)?
apsl-2.0 | 80 | apple | apple public source licen[sc]e( version 2 0)?
ms-pl | 80 | microsoft | microsoft public licen[sc]e
ms-rl | 80 | microsoft | microsoft reciprocal licen[sc]e
ms-pl | 95 | spdx | spdx license identifier ms pl
ms-rl | 95 | spdx | spdx license identifier ms rl
artistic-2.0 | 90 | artistic | artistic licen[sc]e (v|version )?2( 0)?
artistic-1.0 | 90 | artistic | artistic licen[sc]e (v|version )?1( 0)?
artistic | 50 | artistic | artistic licen[sc]e
artistic-2.0 | 95 | spdx | spdx license identifier artistic 2 0
perl | 60 | perl | same terms as perl( itself)?
psf-2.0 | 80 | python | python software foundation licen[sc]e( version 2)?
psf-2.0 | 95 | spdx | spdx license identifier psf 2 0
python-2.0 | 80 | python | python licen[sc]e 2 0
ruby | 80 | ruby | ruby licen[sc]e
php-3.01 | 85 | php | php licen[sc]e (v|version )?3 01
php-3.0 | 85 | php | php licen[sc]e (v|version )?3 0
php | 50 | php | php licen[sc]e
tcl | 80 | tcl | tcl tk licen[sc]e
lua | 60 | lua | lua licen[sc]e
vim | 80 | vim | vim licen[sc]e
zlib | 80 | zlib | (the )?zlib( libpng)? licen[sc]e
zlib | 95 | spdx | spdx license identifier zlib
libpng | 80 | libpng | libpng licen[sc]e
boost-1.0 | 85 | boost | boost software licen[sc]e( version 1 0)?
boost-1.0 | 95 | spdx | spdx license identifier bsl 1 0
unlicense | 80 | unlicense | (the )?unlicense
unlicense | 95 | spdx | spdx license identifier unlicense
unlicense | 85 | unencumbered | free and unencumbered software released into the public domain
wtfpl | 85 | wtfpl | wtfpl( version 2)?
wtfpl | 90 | want | do what the fuck you want to public licen[sc]e
beerware | 80 | beerware | beerware( licen[sc]e)?
beerware | 80 | beer | beer ware licen[sc]e
public-domain | 70 | public | (in|into|to) the public domain
public-domain | 70 | domain | public domain dedication
cc0-1.0 | 90 | cc0 | cc0( 1 0)?( universal)?
cc0-1.0 | 95 | cc0 | spdx license identifier cc0 1 0
cc0-1.0 | 90 | zero | creative commons zero( 1 0)?
cc0-1.0 | 90 | publicdomain | creativecommons org publicdomain zero 1 0
cc-by-4.0 | 80 | cc | cc by 4 0
cc-by-3.0 | 80 | cc | cc by 3 0
cc-by-2.5 | 80 | cc | cc by 2 5
cc-by-2.0 | 80 | cc | cc by 2 0
cc-by-1.0 | 80 | cc | cc by 1 0
cc-by-sa-4.0 | 86 | cc | cc by sa 4 0
cc-by-sa-3.0 | 86 | cc | cc by sa 3 0
cc-by-sa-2.5 | 86 | cc | cc by sa 2 5
cc-by-sa-2.0 | 86 | cc | cc by sa 2 0
cc-by-sa | 75 | cc | cc by sa
cc-by-nc-4.0 | 86 | cc | cc by nc 4 0
cc-by-nc-3.0 | 86 | cc | cc by nc 3 0
cc-by-nc-2.5 | 86 | cc | cc by nc 2 5
cc-by-nc-2.0 | 86 | cc | cc by nc 2 0
cc-by-nc | 75 | cc | cc by nc
cc-by-nd-4.0 | 86 | cc | cc by nd 4 0
cc-by-nd-3.0 | 86 | cc | cc by nd 3 0
cc-by-nd | 75 | cc | cc by nd
cc-by-nc-sa-4.0 | 88 | cc | cc by nc sa 4 0
cc-by-nc-sa-3.0 | 88 | cc | cc by nc sa 3 0
cc-by-nc-sa | 78 | cc | cc by nc sa
cc-by-nc-nd-4.0 | 88 | cc | cc by nc nd 4 0
cc-by-nc-nd-3.0 | 88 | cc | cc by nc nd 3 0
cc-by-nc-nd | 78 | cc | cc by nc nd
cc-by-4.0 | 86 | creative | creative commons attribution 4 0( international)?
cc-by-3.0 | 86 | creative | creative commons attribution 3 0( unported)?
cc-by-2.0 | 86 | creative | creative commons attribution 2 0( generic)?
cc-by-sa-4.0 | 88 | sharealike | creative commons attribution sharealike 4 0( international)?
cc-by-sa-3.0 | 88 | sharealike | creative commons attribution sharealike 3 0( unported)?
cc-by-sa | 80 | creative | creative commons attribution share ?alike
cc-by-nc-4.0 | 88 | noncommercial | creative commons attribution noncommercial 4 0( international)?
cc-by-nc | 80 | creative | creative commons attribution non ?commercial
cc-by-nd-4.0 | 88 | noderivatives | creative commons attribution noderivatives 4 0( international)?
cc-by-nd-4.0 | 88 | noderivs | creative commons attribution noderivs 4 0( international)?
cc-by-nd | 80 | creative | creative commons attribution no ?deriv(ative|ativework)?s
cc-by-nc-sa | 88 | sharealike | creative commons attribution noncommercial sharealike( 4 0| 3 0)?
cc-by-nc-nd | 88 | noncommercial | creative commons attribution noncommercial noderiv(ative)?s( 4 0| 3 0)?
cc-by-4.0 | 86 | creativecommons | creativecommons org licenses by 4 0
cc-by-3.0 | 86 | creativecommons | creativecommons org licenses by 3 0
cc-by-sa-4.0 | 88 | creativecommons | creativecommons org licenses by sa 4 0
cc-by-sa-3.0 | 88 | creativecommons | creativecommons org licenses by sa 3 0
cc-by-nc-4.0 | 88 | creativecommons | creativecommons org licenses by nc 4 0
cc-by-nd-4.0 | 88 | creativecommons | creativecommons org licenses by nd 4 0
cc-by-nc-sa-4.0 | 89 | creativecommons | creativecommons org licenses by nc sa 4 0
cc-by-nc-nd-4.0 | 89 | creativecommons | creativecommons org licenses by nc nd 4 0
creative-commons | 30 | creative | creative commons( licen[sc]e)?
odbl-1.0 | 85 | odbl | odbl( 1 0)?
odbl-1.0 | 88 | database | open (data commons open )?database licen[sc]e
odc-by-1.0 | 85 | odc | odc by( 1 0)?
odc-by-1.0 | 85 | commons | open data commons attribution licen[sc]e
pddl-1.0 | 85 | pddl | pddl( 1 0)?
cdla-permissive | 85 | cdla | cdla permissive( 1 0| 2 0)?
cdla-sharing | 85 | cdla | cdla sharing( 1 0)?
ogl-uk-3.0 | 85 | government | open government licen[sc]e (v|version )?3( 0)?
ogl-uk | 60 | government | open government licen[sc]e
etalab-2.0 | 80 | ouverte | licence ouverte( etalab)?
ofl-1.1 | 90 | sil | sil open font licen[sc]e( version 1 1)?
ofl-1.1 | 95 | spdx | spdx license identifier ofl 1 1
eupl-1.2 | 90 | eupl | eupl (v|version )?1 2
eupl-1.1 | 90 | eupl | eupl (v|version )?1 1
eupl | 60 | european | european union public licen[sc]e
cecill-2.1 | 85 | cecill | cecill 2 1
cecill | 60 | cecill | cecill( b| c)?
osl-3.0 | 85 | open | open software licen[sc]e( (v|version )?3 0)?
afl-3.0 | 85 | academic | academic free licen[sc]e( (v|version )?3 0)?
ecl-2.0 | 85 | educational | educational community licen[sc]e( version 2 0)?
upl-1.0 | 85 | universal | universal permissive licen[sc]e( version 1 0)?
ncsa | 85 | illinois | university of illinois ncsa open source licen[sc]e
ntp | 80 | ntp | ntp licen[sc]e
postgresql | 80 | postgresql | postgresql licen[sc]e
openssl | 80 | openssl | openssl licen[sc]e
curl | 80 | curl | curl licen[sc]e
ijg | 80 | jpeg | independent jpeg group licen[sc]e
unicode | 80 | unicode | unicode licen[sc]e( agreement)?( v3)?
w3c | 80 | w3c | w3c (software )?(notice and )?licen[sc]e
sleepycat | 80 | sleepycat | sleepycat licen[sc]e
qpl-1.0 | 80 | q | q public licen[sc]e
zpl-2.1 | 80 | zope | zope public licen[sc]e( version 2 1)?
bsl-1.1 | 85 | business | business source licen[sc]e( 1 1)?
sspl-1.0 | 85 | server | server side public licen[sc]e( version 1)?
elastic-2.0 | 85 | elastic | elastic licen[sc]e( 2 0| v2)?
polyform | 80 | polyform | polyform (noncommercial|small business|shield|perimeter|strict)( licen[sc]e)?( 1 0 0)?
commons-clause | 80 | clause | commons clause( licen[sc]e)?
rail | 80 | rail | (open rail|creativeml open rail)( m)?( licen[sc]e)?
rail | 80 | openrail | openrail( m)?( licen[sc]e)?
llama-community | 80 | llama | llama( 2| 3)? community licen[sc]e
json | 80 | evil | the software shall be used for good not evil
mulan-2.0 | 85 | mulan | mulan (psl|permissive software licen[sc]e)( v2| version 2)?
blueoak-1.0.0 | 85 | oak | blue oak model licen[sc]e( 1 0 0)?
proprietary | 60 | proprietary | proprietary (and confidential|licen[sc]e|software)
proprietary | 60 | confidential | confidential and proprietary
proprietary | 60 | unauthorized | unauthorized (copying|reproduction|distribution)( or [a-z]+)*( of this file)?
proprietary | 60 | permission | (without|except with) (the )?(prior |express )?(written )?permission
copyright | 25 | copyright | copyright( c)? [0-9]{4}( [0-9]{4})?
copyright | 25 | © | © [0-9]{4}
licensed | 20 | licensed | licensed under( the)?
licensed | 20 | license | see the license( file)? for( the)?( specific)?
warranty | 20 | warranty | (provided )?as is without warranty( of any kind)?
warranty | 20 | warranties | without warranties or conditions of any kind
"""
