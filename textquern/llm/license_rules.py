"""Hand-written license rules: `label priority gate pattern`, in order.

A pattern runs over lower-case words with one space between them (punctuation is a space, so 2.0 is
"2 0"); the gate is a word, or words with | between of which one must be in the text: every branch of
the pattern has one. Higher priorities beat lower ones where
detections overlap: 90 full grants, 80 named licenses with a version, 70 named licenses, 60
identifiers, 40 hints. `~` stands for up to four words.
"""

RULES = """
mit 90 mit (?:released|licensed|distributed|available|provided) under the mit license
mit 90 permission permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit 85 merchantability the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability
mit 80 mit the mit license(?: mit)?
mit 80 expat (?:the )?expat license
mit 70 mit mit licen[sc]e[ds]?
mit 60 mit (?:spdx )?license(?: identifier)? mit
mit 60 mit under (?:the )?(?:terms of )?(?:the )?mit
mit-0 80 mit mit 0(?: license)?
mit-0 80 attribution mit no attribution
x11 80 x11 (?:the )?x11 license
x11 80 consortium mit x consortium license
isc 90 permission permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
isc 90 permission permission to use copy modify and or distribute this software for any purpose with or without fee
isc 80 isc (?:the )?isc license
isc 60 isc license(?: identifier)? isc
0bsd 80 bsd (?:zero clause bsd|bsd zero clause)(?: license)?
0bsd 60 0bsd 0bsd
apache-2 90 apache licensed under the apache license version 2(?: 0)?(?: the license)?
apache-2 90 apache (?:released|available|distributed|published) under ~ apache license version 2(?: 0)?
apache-2 85 apache http www apache org licenses license 2 0
apache-2 80 apache apache license version 2(?: 0)?
apache-2 80 apache apache (?:software )?license 2(?: 0)?
apache-2 80 apache apache 2(?: 0)? license
apache-2 60 apache apache 2 0
apache-2 60 alv2 alv2
apache-1-1 85 apache apache (?:software )?license version 1 1
apache-1-1 75 apache apache 1 1
apache-1 80 apache apache (?:software )?license version 1 0
apache 50 apache (?:the )?apache (?:software )?licen[sc]e
apache 40 apache apache style license
gpl-3 92 gnu (?:licensed|released|distributed|available) under the gnu general public license version 3
gpl-3 88 gnu gnu general public license version 3(?: 0)?
gpl-3 88 gnu gnu general public license as published by the free software foundation (?:either )?version 3
gpl-3 80 gplv3 gplv3
gpl-3 80 gpl (?:gnu )?gpl (?:version |v )?3(?: 0)?(?: only)?
gpl-3-or-later 94 gnu gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version
gpl-3-or-later 90 gnu gnu general public license version 3 or (?:any )?later
gpl-3-or-later 85 gpl gpl 3 0 or later
gpl-3-or-later 85 gplv3 gplv3 or later
gpl-2 92 gnu (?:licensed|released|distributed|available) under the gnu general public license version 2
gpl-2 88 gnu gnu general public license version 2(?: 0)?
gpl-2 88 gnu gnu general public license as published by the free software foundation (?:either )?version 2
gpl-2 80 gplv2 gplv2
gpl-2 80 gpl (?:gnu )?gpl (?:version |v )?2(?: 0)?(?: only)?
gpl-2-or-later 94 gnu gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version
gpl-2-or-later 90 gnu gnu general public license version 2 or (?:any )?later
gpl-2-or-later 85 gpl gpl 2 0 or later
gpl-2-or-later 85 gplv2 gplv2 or later
gpl-1 80 gnu gnu general public license version 1(?: 0)?
gpl-1 75 gpl gpl 1 0
gpl-classpath 90 classpath gnu general public license ~ with (?:the )?classpath exception
gpl-classpath 80 classpath classpath exception 2 0
gpl-font 80 font gpl ~ with font exception
gpl 60 gnu gnu general public licen[sc]e
gpl 50 gpl (?:gnu )?gpl licen[sc]ed?
gpl 50 gpl under the gpl
gpl 40 copyleft copyleft license
lgpl-3 88 lesser gnu lesser general public license version 3(?: 0)?
lgpl-3 80 lgplv3 lgplv3
lgpl-3 80 lgpl lgpl (?:version |v )?3(?: 0)?
lgpl-3-or-later 92 lesser gnu lesser general public license version 3 or (?:any )?later
lgpl-2-1 88 lesser gnu lesser general public license version 2 1
lgpl-2-1 80 lgpl lgpl (?:version |v )?2 1
lgpl-2-1-or-later 92 lesser gnu lesser general public license ~ version 2 1 ~ any later version
lgpl-2 88 library gnu library general public license version 2(?: 0)?
lgpl-2 80 lgpl lgpl (?:version |v )?2 0
lgpl 60 lesser (?:gnu )?lesser general public licen[sc]e
lgpl 60 library gnu library general public licen[sc]e
lgpl 50 lgpl under the (?:gnu )?lgpl
agpl-3 88 affero gnu affero general public license version 3(?: 0)?
agpl-3 80 agplv3 agplv3
agpl-3 80 agpl agpl (?:version |v )?3(?: 0)?
agpl-3-or-later 92 affero gnu affero general public license version 3 or (?:any )?later
agpl-1 85 affero affero general public license version 1
agpl 60 affero (?:gnu )?affero general public licen[sc]e
agpl 50 agpl under the (?:gnu )?agpl
gfdl-1-3 85 documentation gnu free documentation license version 1 3
gfdl-1-2 85 documentation gnu free documentation license version 1 2
gfdl-1-1 85 documentation gnu free documentation license version 1 1
gfdl 65 documentation gnu free documentation licen[sc]e
gfdl 60 gfdl gfdl
bsd-2 88 redistribution redistribution and use in source and binary forms ~ are permitted
bsd-2 80 bsd (?:the )?bsd 2 clause(?: license)?
bsd-2 80 bsd (?:2|two) clause bsd(?: license)?
bsd-2 80 simplified simplified bsd license
bsd-2 80 freebsd freebsd license
bsd-3 90 endorse neither the name of ~ nor the names of its contributors may be used to endorse
bsd-3 80 bsd (?:the )?bsd 3 clause(?: license)?
bsd-3 80 bsd (?:3|three) clause bsd(?: license)?
bsd-3 80 bsd (?:new|modified|revised) bsd license
bsd-4 80 bsd (?:the )?bsd 4 clause(?: license)?
bsd-4 80 bsd (?:4|four|original) (?:clause )?bsd(?: license)?
bsd-4 85 advertising all advertising materials mentioning features or use of this software
bsd-clear 80 bsd clear bsd license
bsd-patent 80 bsd bsd (?:2 clause plus )?patent(?: license)?
bsd 60 bsd (?:licensed|released|distributed|available) under (?:the )?bsd
bsd 50 bsd bsd (?:style )?licen[sc]e[ds]?
mpl-2 90 mozilla this source code form is subject to the terms of the mozilla public license v 2 0
mpl-2 85 mozilla mozilla public license (?:version |v )?2(?: 0)?
mpl-2 75 mpl mpl (?:version |v )?2(?: 0)?
mpl-1-1 85 mozilla mozilla public license (?:version |v )?1 1
mpl-1-1 75 mpl mpl (?:version |v )?1 1
mpl-1 80 mozilla mozilla public license (?:version |v )?1 0
mpl 60 mozilla mozilla public licen[sc]e
epl-2 85 eclipse eclipse public license (?:version |v )?2(?: 0)?
epl-2 75 epl epl (?:version |v )?2(?: 0)?
epl-1 85 eclipse eclipse public license (?:version |v )?1(?: 0)?
epl-1 75 epl epl (?:version |v )?1(?: 0)?
epl 60 eclipse eclipse public licen[sc]e
edl-1 80 eclipse eclipse distribution license
cddl-1-1 85 cddl (?:common development and distribution license )?cddl (?:version |v )?1 1
cddl-1 85 cddl cddl (?:version |v )?1 0
cddl-1 80 development common development and distribution license (?:version )?1 0
cddl 60 development common development and distribution licen[sc]e
cpl-1 80 common common public license (?:version |v )?1 0
cpl 60 common common public licen[sc]e
ipl-1 80 ibm ibm public license
eupl-1-2 85 european european union public licen[sc]e (?:version |v )?1 2
eupl-1-1 85 european european union public licen[sc]e (?:version |v )?1 1
eupl 60 european european union public licen[sc]e
eupl-1-2 75 eupl eupl (?:version |v )?1 2
artistic-2 85 artistic artistic license (?:version )?2(?: 0)?
artistic-1 80 artistic artistic license (?:version )?1(?: 0)?
artistic 60 artistic (?:the )?(?:perl )?artistic licen[sc]e
perl 60 perl (?:same )?terms as perl(?: itself)?
bsl-1 85 boost boost software license (?:version )?1 0
bsl-1 60 boost boost software licen[sc]e
busl-1-1 85 business business source license (?:version )?1 1
busl-1-1 60 business business source licen[sc]e
zlib 85 zlib (?:the )?zlib (?:libpng )?license
zlib 80 warranty this software is provided as is without any express or implied warranty in no event will the authors be held liable
libpng 80 libpng libpng license
unlicense 90 unencumbered this is free and unencumbered software released into the public domain
unlicense 80 unlicense (?:the )?unlicense
wtfpl 80 wtfpl wtfpl
wtfpl 80 fuck do what the fuck you want to public license
cc0-1 90 cc0|zero (?:cc0|creative commons zero) (?:1 0 universal|v1 0|universal)
cc0-1 85 dedication public domain dedication ~ creative commons
cc0-1 70 cc0 cc0
cc-pdm 75 mark public domain mark
cc-by-nc-nd-4 88 nd cc by nc nd 4 0
cc-by-nc-nd-3 88 nd cc by nc nd 3 0
cc-by-nc-nd 78 nd cc by nc nd
cc-by-nc-nd 78 attribution creative commons attribution non ?commercial no ?derivatives
cc-by-nc-nd 78 attribution creative commons attribution non ?commercial no ?derivs
cc-by-nc-sa-4 88 sa cc by nc sa 4 0
cc-by-nc-sa-3 88 sa cc by nc sa 3 0
cc-by-nc-sa 78 sa cc by nc sa
cc-by-nc-sa 78 attribution creative commons attribution non ?commercial share ?alike
cc-by-nc-4 85 nc (?:licensed under )?cc by nc 4 0
cc-by-nc-3 85 nc (?:licensed under )?cc by nc 3 0
cc-by-nc-2 85 nc (?:licensed under )?cc by nc 2 [05]
cc-by-nc 76 nc (?:licensed under )?cc by nc
cc-by-nc 76 attribution creative commons attribution non ?commercial(?: license)?
cc-by-nc-4 86 attribution creative commons attribution non ?commercial 4 0 international
cc-by-sa-4 85 sa cc by sa 4 0
cc-by-sa-3 85 sa cc by sa 3 0
cc-by-sa 74 sa cc by sa
cc-by-sa 74 attribution creative commons attribution share ?alike
cc-by-sa-4 86 attribution creative commons attribution share ?alike 4 0 international
cc-by-nd-4 85 nd cc by nd 4 0
cc-by-nd 74 nd cc by nd
cc-by-nd 74 attribution creative commons attribution no ?derivatives
cc-by-4 84 by cc by 4 0
cc-by-3 84 by cc by 3 0
cc-by-2 84 by cc by 2 [05]
cc-by 60 attribution creative commons attribution(?: license)?
cc-by-4 82 attribution creative commons attribution 4 0(?: international)?
cc-by-3 82 attribution creative commons attribution 3 0(?: unported)?
cc 50 commons (?:licensed under )?(?:a )?creative commons(?: licen[sc]e)?
cc-url 84 creativecommons creativecommons org licenses by(?: nc)?(?: sa| nd)? [1-4] [05]
cc0-1 84 creativecommons creativecommons org publicdomain zero 1 0
odbl-1 85 odbl (?:open database license )?odbl(?: 1 0)?
odbl-1 80 database open (?:data commons open )?database license
odc-by-1 85 odc odc by(?: 1 0)?
odc-by-1 80 commons open data commons attribution license
pddl-1 80 pddl pddl(?: 1 0)?
cdla-permissive 80 community community data license agreement permissive
cdla-sharing 80 community community data license agreement sharing
ogl-3 80 open open government licen[sc]e (?:version |v )?3(?: 0)?
ogl 60 government open government licen[sc]e
etalab-2 80 etalab etalab ~ (?:open licen[sc]e )?2 0
ofl-1-1 85 sil (?:this font software is )?licensed under the sil open font license(?: version)?(?: 1 1)?
ofl-1-1 80 ofl ofl 1 1
ofl 65 font (?:sil )?open font licen[sc]e
psf-2 80 python python software foundation license(?: version)?(?: 2)?
psf-2 60 psf psf license
php-3 80 php (?:the )?php license(?: version)?(?: 3 0[01])?
ruby 70 ruby (?:same )?(?:license as|terms as) ruby
ruby 70 ruby ruby licen[sc]e
postgresql 80 postgresql postgresql licen[sc]e
openssl 80 openssl openssl licen[sc]e
ssleay 75 ssleay ssleay licen[sc]e
curl 75 curl curl licen[sc]e
vim 75 vim vim licen[sc]e
ncsa 80 ncsa (?:university of illinois )?ncsa(?: open source)? license
llvm-exception 85 llvm apache ~ with llvm exceptions?
unicode 80 unicode unicode(?: inc)? license(?: agreement)?
w3c 80 w3c w3c (?:software )?(?:notice and )?license
osl-3 80 open open software license (?:version |v )?3(?: 0)?
afl-3 80 academic academic free license (?:version |v )?3(?: 0)?
afl 60 academic academic free licen[sc]e
ms-pl 85 microsoft microsoft public license(?: ms pl)?
ms-rl 85 microsoft microsoft reciprocal license(?: ms rl)?
ms-rsl 80 microsoft microsoft reference source license
apsl-2 80 apple apple public source license(?: version)?(?: 2 0)?
nasa-1-3 80 nasa nasa open source agreement(?: version)?(?: 1 3)?
rpl-1-5 80 reciprocal reciprocal public license(?: version)?(?: 1 5)?
cecill-2-1 80 cecill cecill(?: free software license)?(?: agreement)?(?: v?2 1)?
cecill-b 85 cecill cecill b
cecill-c 85 cecill cecill c
qpl-1 80 public q public license
sleepycat 80 sleepycat sleepycat licen[sc]e
sspl-1 85 server server side public license(?: v(?:ersion)? ?1)?
elastic-2 85 elastic elastic license(?: version)?(?: 2 0)?
confluent-1 80 confluent confluent community license
commons-clause 80 clause commons clause
polyform-nc 80 polyform polyform noncommercial license(?: 1 0 0)?
polyform 70 polyform polyform [a-z]+ licen[sc]e
prosperity 75 prosperity prosperity public license
parity 75 parity parity public license
blueoak 80 blue blue oak model license(?: 1 0 0)?
mulan-2 80 mulan mulan psl v2
mulan-2 78 mulan mulan permissive software license(?: version 2)?
upl-1 80 universal universal permissive license(?: v(?:ersion)? ?1 0)?
json 80 evil the software shall be used for good not evil
beerware 80 beer|beerware (?:the )?beer ?ware license
beerware 80 beerware beerware
openrail-m 80 openrail|rail (?:bigscience |creativeml )?open ?rail(?: m)?(?: license)?
rail 75 responsible responsible ai licen[sc]es?
llama-2 85 llama llama 2 community license
llama-3 85 llama llama 3(?: [123])? community license
gemma 80 gemma gemma terms of use
public-domain 65 domain (?:released|dedicated|placed) (?:in ?to|to|in) the public domain
public-domain 50 domain (?:is )?in the public domain
proprietary 75 reserved all rights reserved
proprietary 75 proprietary proprietary and confidential
proprietary 75 copying unauthorized copying of this file ~ is strictly prohibited
proprietary 65 proprietary proprietary licen[sc]e
proprietary 65 agreement end user license agreement
proprietary 65 user end user licen[sc]e agreement
shareware 60 shareware shareware licen[sc]e
freeware 60 freeware freeware licen[sc]e
noncommercial 60 commercial|noncommercial for non ?commercial (?:use|purposes) only
research-only 60 research for research (?:use|purposes) only
no-redistribution 60 redistributed may not be redistributed
dual 60 dual dual licensed under
spdx 40 spdx spdx license identifier
copyright 40 copyright copyright (?:c )?(?:19|20)[0-9][0-9]
licensed 30 licensed (?:is |are )?licensed under (?:the )?(?:terms of )?
licensed 30 license see (?:the )?license (?:file )?for (?:details|more)
licensed 30 license license agreement
"""


def parse(text: str = RULES) -> list[tuple[str, int, str, str]]:
    """(label, priority, gate, pattern) in order."""
    out = []
    for line in text.strip().splitlines():
        label, priority, gate, pattern = line.split(" ", 3)
        out.append((label, int(priority), gate, pattern.replace(" ~ ", r"(?: [^ ]+){0,4} ").strip()))
    return out
