"""Hand-written signature rules of licenses.

A rule is a line of five fields: class, label, keyword, pattern. Patterns are read over the words of
a text in lower case with one blank between them, so '2.0' is '2 0' and a URL is its words. They
match whole words. The keyword is a run of words that every match holds.

Classes, strongest first: ``text`` is wording of the license itself, ``tag`` a machine-readable name,
``url`` the address of a license, ``grant`` a sentence that puts a work under a license, ``name`` the name alone.
"""

from __future__ import annotations

from typing import NamedTuple

#: Classes with their priority (lower wins) and the score of a detection.
CLASSES = {"text": (1, 1.0), "tag": (2, 0.95), "url": (3, 0.9), "grant": (4, 0.85), "name": (5, 0.7)}

RULES_TEXT = r"""
text | mit | permission is hereby granted | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
text | mit | to deal in the software | to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute
text | mit | in no event shall the authors | in no event shall the authors or copyright holders be liable for any claim damages or other liability
text | mit-0 | permission is hereby granted | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided as is
text | x11 | x consortium | except as contained in this notice the name of the x consortium shall not be used in advertising
text | isc | permission to use copy | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
text | isc | permission to use copy | permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided
text | 0bsd | permission to use copy | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is
text | bsd | redistribution and use | redistribution and use in source and binary forms with or without modification are permitted
text | bsd-2-clause | redistribution and use | redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met (?:1 )?redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer (?:2 )?redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution this software
text | bsd-3-clause | to endorse or promote products | neither the names? of (?:[^ ]+ ){1,24}?may be used to endorse or promote products derived from this software
text | bsd-3-clause | to endorse or promote products | the names? of (?:[^ ]+ ){1,12}?may not be used to endorse or promote products derived from this software
text | bsd-4-clause | this product includes software | all advertising materials mentioning features or use of this software must display the following acknowledge?ment this product includes software
text | apache-1.1 | this product includes software | the end user documentation included with the redistribution if any must include the following acknowledge?ment this product includes software developed by the apache software foundation
text | apache-2.0 | you may not use this file | you may not use this file except in compliance with the license
text | apache-2.0 | terms and conditions for use | terms and conditions for use reproduction and distribution 1 definitions license shall mean
text | apache-2.0 | grant of patent license | grant of patent license subject to the terms and conditions of this license each contributor hereby grants to you
text | gpl | this program is free software | this program is free software you can redistribute it and or modify it under the terms of the gnu general public license
text | gpl-2.0-or-later | either version 2 | gnu general public license as published by the free software foundation either version 2 of the license or (?:at your option )?any later version
text | gpl-3.0-or-later | either version 3 | gnu general public license as published by the free software foundation either version 3 of the license or (?:at your option )?any later version
text | gpl-2.0-only | version 2 | gnu general public license as published by the free software foundation version 2(?: of the license)?(?: only)?
text | gpl-2.0 | most software are designed | the licenses for most software are designed to take away your freedom to share and change it by contrast the gnu general public license
text | gpl-3.0 | copyleft license for software | the gnu general public license is a free copyleft license for software and other kinds of works
text | lgpl-2.1-or-later | either version 2 1 | gnu lesser general public license as published by the free software foundation either version 2 1 of the license or (?:at your option )?any later version
text | lgpl-3.0-or-later | either version 3 | gnu lesser general public license as published by the free software foundation either version 3 of the license or (?:at your option )?any later version
text | lgpl-2.0-or-later | either version 2 | gnu library general public license as published by the free software foundation either version 2 of the license or (?:at your option )?any later version
text | agpl-3.0-or-later | either version 3 | gnu affero general public license as published by the free software foundation either version 3 of the license or (?:at your option )?any later version
text | agpl-3.0 | affero general public license is | the gnu affero general public license is a free copyleft license for software and other kinds of works
text | gfdl | permission is granted to copy | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
text | mpl-2.0 | this source code form | this source code form is subject to the terms of the mozilla public license v 2 0
text | mpl-1.1 | the contents of this file | the contents of this file are subject to the mozilla public license version 1 1
text | epl-1.0 | eclipse public license v1 0 | this program and the accompanying materials are made available under the terms of the eclipse public license v1 0
text | epl-2.0 | eclipse public license 2 0 | this program and the accompanying materials are made available under the terms of the eclipse public license 2 0
text | cddl-1.0 | common development and distribution | subject to the terms of the common development and distribution license
text | zlib | this software is provided | this software is provided as is without any express or implied warranty in no event will the authors be held liable
text | zlib | must not be misrepresented | the origin of this software must not be misrepresented you must not claim that you wrote the original software
text | bsl-1.0 | permission is hereby granted | permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license
text | unlicense | free and unencumbered | this is free and unencumbered software released into the public domain
text | wtfpl | do what the fuck | you just do what the fuck you want to
text | cc0-1.0 | to the extent possible under law | to the extent possible under law (?:[^ ]+ ){1,16}?has waived all copyright and related or neighbou?ring rights
text | artistic-2.0 | everyone is permitted to copy | everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed preamble this license establishes the terms under which a given free software package
text | ofl-1.1 | this font software is licensed | this font software is licensed under the sil open font license version 1 1
text | python-2.0 | psf hereby grants licensee | psf hereby grants licensee a nonexclusive royalty free world wide license
text | postgresql | permission to use copy | permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted
text | openssl | openssl project | this product includes software developed by the openssl project for use in the openssl toolkit
text | curl | permission to use copy | permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies
text | ncsa | permission is hereby granted | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal with the software without restriction
text | unicode-dfs-2016 | permission is hereby granted | permission is hereby granted free of charge to any person obtaining a copy of the unicode data files
text | ruby | you may make and give away | you may make and give away verbatim copies of the source form of the software without restriction
text | vim | there are no restrictions on distributing | there are no restrictions on distributing unmodified copies of vim
text | beerware | if we meet some day | if we meet some day and you think this stuff is worth it you can buy me a beer in return
text | json | shall be used for good | the software shall be used for good not evil
text | eupl-1.2 | under the eupl | licensed under the eupl version 1 2 or as soon they will be approved by the european commission
text | sspl-1.0 | offering the program as a service | offering the program as a service
text | busl-1.1 | make non production use | the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work
text | elastic-2.0 | hosted or managed service | you may not provide the software to third parties as a hosted or managed service
text | commons-clause | under the license as defined below | the software is provided to you by the licensor under the license as defined below subject to the following condition
text | all-rights-reserved | all rights reserved | copyright (?:c )?(?:[^ ]+ ){1,12}?all rights reserved
text | proprietary | proprietary and confidential | (?:this (?:file|document|software) is )?proprietary and confidential
text | proprietary | unauthorized copying | unauthorized copying of this file via any medium is strictly prohibited
text | public-domain | public domain | (?:dedicates?|dedicated|released?|placed?|put) (?:this (?:work|software|file|code) )?(?:in|into|to) the public domain
text | public-domain | united states government work | (?:this is )?a united states government work
tag | mit | identifier mit | spdx license identifier mit
tag | mit-0 | identifier mit 0 | spdx license identifier mit 0
tag | isc | identifier isc | spdx license identifier isc
tag | 0bsd | identifier 0bsd | spdx license identifier 0bsd
tag | apache-2.0 | identifier apache | spdx license identifier apache 2 0
tag | apache-1.1 | identifier apache | spdx license identifier apache 1 1
tag | bsd-2-clause | identifier bsd | spdx license identifier bsd 2 clause
tag | bsd-3-clause | identifier bsd | spdx license identifier bsd 3 clause
tag | bsd-4-clause | identifier bsd | spdx license identifier bsd 4 clause
tag | bsd-1-clause | identifier bsd | spdx license identifier bsd 1 clause
tag | gpl-1.0-only | identifier gpl | spdx license identifier gpl 1 0(?: only)?
tag | gpl-1.0-or-later | identifier gpl | spdx license identifier gpl 1 0 or later
tag | gpl-2.0-only | identifier gpl | spdx license identifier gpl 2 0(?: only)?
tag | gpl-2.0-or-later | identifier gpl | spdx license identifier gpl 2 0 or later
tag | gpl-3.0-only | identifier gpl | spdx license identifier gpl 3 0(?: only)?
tag | gpl-3.0-or-later | identifier gpl | spdx license identifier gpl 3 0 or later
tag | gpl-2.0-with-classpath-exception | classpath exception | spdx license identifier gpl 2 0(?: only| or later)? with classpath exception 2 0
tag | lgpl-2.0-only | identifier lgpl | spdx license identifier lgpl 2 0(?: only)?
tag | lgpl-2.0-or-later | identifier lgpl | spdx license identifier lgpl 2 0 or later
tag | lgpl-2.1-only | identifier lgpl | spdx license identifier lgpl 2 1(?: only)?
tag | lgpl-2.1-or-later | identifier lgpl | spdx license identifier lgpl 2 1 or later
tag | lgpl-3.0-only | identifier lgpl | spdx license identifier lgpl 3 0(?: only)?
tag | lgpl-3.0-or-later | identifier lgpl | spdx license identifier lgpl 3 0 or later
tag | agpl-3.0-only | identifier agpl | spdx license identifier agpl 3 0(?: only)?
tag | agpl-3.0-or-later | identifier agpl | spdx license identifier agpl 3 0 or later
tag | mpl-1.1 | identifier mpl | spdx license identifier mpl 1 1
tag | mpl-2.0 | identifier mpl | spdx license identifier mpl 2 0
tag | epl-1.0 | identifier epl | spdx license identifier epl 1 0
tag | epl-2.0 | identifier epl | spdx license identifier epl 2 0
tag | cddl-1.0 | identifier cddl | spdx license identifier cddl 1 0
tag | cddl-1.1 | identifier cddl | spdx license identifier cddl 1 1
tag | zlib | identifier zlib | spdx license identifier zlib
tag | bsl-1.0 | identifier bsl | spdx license identifier bsl 1 0
tag | unlicense | identifier unlicense | spdx license identifier unlicense
tag | wtfpl | identifier wtfpl | spdx license identifier wtfpl
tag | cc0-1.0 | identifier cc0 | spdx license identifier cc0 1 0
tag | cc-by-4.0 | identifier cc by | spdx license identifier cc by 4 0
tag | cc-by-3.0 | identifier cc by | spdx license identifier cc by 3 0
tag | cc-by-sa-4.0 | identifier cc by | spdx license identifier cc by sa 4 0
tag | cc-by-sa-3.0 | identifier cc by | spdx license identifier cc by sa 3 0
tag | cc-by-nc-4.0 | identifier cc by | spdx license identifier cc by nc 4 0
tag | cc-by-nd-4.0 | identifier cc by | spdx license identifier cc by nd 4 0
tag | cc-by-nc-sa-4.0 | identifier cc by | spdx license identifier cc by nc sa 4 0
tag | cc-by-nc-nd-4.0 | identifier cc by | spdx license identifier cc by nc nd 4 0
tag | artistic-1.0 | identifier artistic | spdx license identifier artistic 1 0
tag | artistic-2.0 | identifier artistic | spdx license identifier artistic 2 0
tag | ofl-1.1 | identifier ofl | spdx license identifier ofl 1 1
tag | python-2.0 | identifier python | spdx license identifier python 2 0
tag | psf-2.0 | identifier psf | spdx license identifier psf 2 0
tag | postgresql | identifier postgresql | spdx license identifier postgresql
tag | openssl | identifier openssl | spdx license identifier openssl
tag | ncsa | identifier ncsa | spdx license identifier ncsa
tag | eupl-1.1 | identifier eupl | spdx license identifier eupl 1 1
tag | eupl-1.2 | identifier eupl | spdx license identifier eupl 1 2
tag | sspl-1.0 | identifier sspl | spdx license identifier sspl 1 0
tag | busl-1.1 | identifier busl | spdx license identifier busl 1 1
tag | elastic-2.0 | identifier elastic | spdx license identifier elastic 2 0
tag | ms-pl | identifier ms pl | spdx license identifier ms pl
tag | ms-rl | identifier ms rl | spdx license identifier ms rl
tag | afl-3.0 | identifier afl | spdx license identifier afl 3 0
tag | osl-3.0 | identifier osl | spdx license identifier osl 3 0
tag | odbl-1.0 | identifier odbl | spdx license identifier odbl 1 0
tag | odc-by-1.0 | identifier odc by | spdx license identifier odc by 1 0
tag | mulanpsl-2.0 | identifier mulanpsl | spdx license identifier mulanpsl 2 0
tag | upl-1.0 | identifier upl | spdx license identifier upl 1 0
tag | blueoak-1.0.0 | identifier blueoak | spdx license identifier blueoak 1 0 0
tag | mit | osi approved mit | (?:classifier )?license osi approved mit license
tag | apache-2.0 | osi approved apache | (?:classifier )?license osi approved apache software license
tag | bsd | osi approved bsd | (?:classifier )?license osi approved bsd license
tag | gpl-3.0 | osi approved gnu | (?:classifier )?license osi approved gnu general public license v3 gplv3
tag | gpl-2.0 | osi approved gnu | (?:classifier )?license osi approved gnu general public license v2 gplv2
tag | lgpl-3.0 | osi approved gnu | (?:classifier )?license osi approved gnu lesser general public license v3 lgplv3
tag | mpl-2.0 | osi approved mozilla | (?:classifier )?license osi approved mozilla public license 2 0 mpl 2 0
url | apache-2.0 | apache org licenses | (?:www )?apache org licenses license 2 0(?: html| txt)?
url | apache-1.1 | apache org licenses | (?:www )?apache org licenses license 1 1(?: html| txt)?
url | mit | org licenses mit | (?:www )?opensource org licenses mit(?: license)?(?: php| html)?
url | bsd-3-clause | org licenses bsd | (?:www )?opensource org licenses bsd 3 clause
url | bsd-2-clause | org licenses bsd | (?:www )?opensource org licenses bsd 2 clause
url | bsd | org licenses bsd | (?:www )?opensource org licenses bsd license(?: php| html)?
url | isc | org licenses isc | (?:www )?opensource org licenses isc(?: license)?
url | gpl-2.0 | org licenses gpl | (?:www )?opensource org licenses gpl 2 0
url | gpl-3.0 | org licenses gpl | (?:www )?opensource org licenses gpl 3 0
url | zlib | org licenses zlib | (?:www )?opensource org licenses zlib
url | artistic-2.0 | org licenses artistic | (?:www )?opensource org licenses artistic license 2 0
url | gpl-3.0 | gnu org licenses | (?:www )?gnu org licenses gpl 3 0(?: en)?(?: html| txt)?
url | gpl-2.0 | gnu org licenses | (?:www )?gnu org licenses (?:old licenses )?gpl 2 0(?: en)?(?: html| txt)?
url | gpl | gnu org licenses | (?:www )?gnu org licenses gpl(?: html| txt)?
url | gpl | gnu org copyleft | (?:www )?gnu org copyleft gpl(?: html)?
url | lgpl-2.1 | gnu org licenses | (?:www )?gnu org licenses (?:old licenses )?lgpl 2 1(?: en)?(?: html| txt)?
url | lgpl-3.0 | gnu org licenses | (?:www )?gnu org licenses lgpl 3 0(?: en)?(?: html| txt)?
url | lgpl | gnu org licenses | (?:www )?gnu org licenses lgpl(?: html| txt)?
url | agpl-3.0 | gnu org licenses | (?:www )?gnu org licenses agpl(?: 3 0)?(?: en)?(?: html| txt)?
url | gfdl | gnu org licenses | (?:www )?gnu org licenses fdl(?: 1 3)?(?: en)?(?: html| txt)?
url | mpl-2.0 | mozilla org | (?:www )?mozilla org (?:en us )?mpl 2 0
url | mpl-1.1 | mozilla org | (?:www )?mozilla org mpl (?:mpl )?1 1(?: html)?
url | epl-1.0 | eclipse org | (?:www )?eclipse org (?:legal|org documents) epl v10(?: html)?
url | epl-2.0 | eclipse org | (?:www )?eclipse org (?:legal|org documents) epl (?:v20|2 0)(?: html)?
url | unlicense | unlicense org | (?:www )?unlicense org
url | wtfpl | wtfpl net | (?:www )?wtfpl net
url | bsl-1.0 | boost org | (?:www )?boost org license 1 0(?: txt)?
url | cc0-1.0 | publicdomain zero | (?:www )?creativecommons org publicdomain zero 1 0
url | public-domain | publicdomain mark | (?:www )?creativecommons org publicdomain mark 1 0
url | cc-by-4.0 | creativecommons org | (?:www )?creativecommons org licenses by 4 0
url | cc-by-3.0 | creativecommons org | (?:www )?creativecommons org licenses by 3 0
url | cc-by-2.0 | creativecommons org | (?:www )?creativecommons org licenses by 2 0
url | cc-by-sa-4.0 | creativecommons org | (?:www )?creativecommons org licenses by sa 4 0
url | cc-by-sa-3.0 | creativecommons org | (?:www )?creativecommons org licenses by sa 3 0
url | cc-by-nc-4.0 | creativecommons org | (?:www )?creativecommons org licenses by nc 4 0
url | cc-by-nd-4.0 | creativecommons org | (?:www )?creativecommons org licenses by nd 4 0
url | cc-by-nc-sa-4.0 | creativecommons org | (?:www )?creativecommons org licenses by nc sa 4 0
url | cc-by-nc-nd-4.0 | creativecommons org | (?:www )?creativecommons org licenses by nc nd 4 0
url | odbl-1.0 | opendatacommons org | (?:www )?opendatacommons org licenses odbl(?: 1 0)?
url | ofl-1.1 | scripts sil org | scripts sil org ofl
url | eupl-1.2 | eupl | joinup ec europa eu (?:[^ ]+ ){0,6}?eupl
url | sspl-1.0 | mongodb com | (?:www )?mongodb com licensing server side public license
url | elastic-2.0 | elastic co | (?:www )?elastic co licensing elastic license
grant | mit | mit | (?:released|licensed|available|distributed|published|provided) under the (?:terms of the )?mit(?: x11| expat)? license
grant | mit | under mit | (?:released|licensed|available|distributed|published|provided) under mit
grant | isc | isc license | (?:released|licensed|available|distributed|published|provided) under the (?:terms of the )?isc license
grant | apache-2.0 | apache license | (?:released|licensed|available|distributed|published|provided) under (?:the )?(?:terms of the )?apache license (?:v|version |v )?2(?: 0)?
grant | apache | apache license | (?:released|licensed|available|distributed|published|provided) under (?:the )?(?:terms of the )?apache license
grant | bsd | bsd | (?:released|licensed|available|distributed|published|provided) under (?:the |a )?(?:terms of the )?(?:modified |new |simplified |revised )?bsd(?: style)? license
grant | gpl-3.0 | general public license | licensed under the (?:terms of the )?(?:gnu )?general public license (?:v|version |v )?3(?: 0)?
grant | gpl-2.0 | general public license | licensed under the (?:terms of the )?(?:gnu )?general public license (?:v|version |v )?2(?: 0)?
grant | gpl | general public license | (?:released|licensed|available|distributed|published|provided) under the (?:terms of the )?(?:gnu )?general public license
grant | gpl | gpl | (?:released|licensed|available|distributed|published|provided) under (?:the )?(?:terms of the )?(?:gnu )?gpl
grant | lgpl | lgpl | (?:released|licensed|available|distributed|published|provided) under (?:the )?(?:terms of the )?(?:gnu )?lgpl
grant | agpl | agpl | (?:released|licensed|available|distributed|published|provided) under (?:the )?(?:terms of the )?(?:gnu )?agpl
grant | mpl-2.0 | mozilla public license | (?:released|licensed|available|distributed|published|provided) under the (?:terms of the )?mozilla public license (?:v|version |v )?2(?: 0)?
grant | epl | eclipse public license | (?:released|licensed|available|distributed|published|provided) under the (?:terms of the )?eclipse public license
grant | cc-by-4.0 | cc by 4 0 | licensed under (?:a |the )?cc by 4 0
grant | cc-by-nc-4.0 | cc by nc | licensed under (?:a |the )?cc by nc 4 0
grant | cc-by-sa-4.0 | cc by sa | licensed under (?:a |the )?cc by sa 4 0
grant | cc-by-nd-4.0 | cc by nd | licensed under (?:a |the )?cc by nd 4 0
grant | cc-by-nc-sa-4.0 | cc by nc sa | licensed under (?:a |the )?cc by nc sa 4 0
grant | cc-by-nc-nd-4.0 | cc by nc nd | licensed under (?:a |the )?cc by nc nd 4 0
grant | cc-by | creative commons attribution | licensed under (?:a |the )?creative commons attribution(?: 4 0| 3 0)?(?: international| unported)? license
grant | cc0-1.0 | cc0 | (?:released|licensed|available|distributed|published|dedicated) under (?:the )?cc0
grant | unlicense | the unlicense | (?:released|licensed|available|distributed|published) under the unlicense
grant | dual-license | dual licensed | dual licensed under (?:[^ ]+ ){1,12}?(?:and|or) (?:the )?[^ ]+
grant | proprietary | for internal use only | for internal use only
name | mit | mit license | (?:the )?mit license
name | mit | expat license | (?:the )?expat license
name | x11 | x11 license | (?:the )?x11 license
name | isc | isc license | (?:the )?isc license
name | bsd | bsd license | (?:the )?(?:modified |new |simplified |revised )?bsd license
name | bsd-2-clause | bsd | (?:2 clause bsd|two clause bsd|bsd 2 clause|simplified bsd)(?: license)?
name | bsd-2-clause | freebsd license | (?:the )?freebsd license
name | bsd-3-clause | bsd | (?:3 clause bsd|three clause bsd|bsd 3 clause|new bsd|modified bsd)(?: license)?
name | bsd-4-clause | bsd | (?:4 clause bsd|four clause bsd|bsd 4 clause|original bsd)(?: license)?
name | 0bsd | 0bsd | 0bsd(?: license)?
name | 0bsd | zero clause bsd | zero clause bsd(?: license)?
name | apache-2.0 | apache | apache(?: software)? license (?:v|version |v )?2(?: 0)?
name | apache-1.1 | apache | apache(?: software)? license (?:v|version |v )?1 1
name | apache-1.0 | apache | apache(?: software)? license (?:v|version |v )?1 0
name | apache-2.0 | apache 2 0 | apache 2 0(?: license)?
name | apache-2.0 | asl 2 0 | asl 2 0
name | gpl-3.0 | general public license | gnu general public license (?:v|version |v )?3(?: 0)?
name | gpl-2.0 | general public license | gnu general public license (?:v|version |v )?2(?: 0)?
name | gpl-1.0 | general public license | gnu general public license (?:v|version |v )?1(?: 0)?
name | gpl-3.0 | gplv3 | (?:gnu )?gplv3
name | gpl-3.0 | gpl | (?:gnu )?gpl (?:v3|version 3|3)(?: 0)?
name | gpl-2.0 | gplv2 | (?:gnu )?gplv2
name | gpl-2.0 | gpl | (?:gnu )?gpl (?:v2|version 2|2)(?: 0)?
name | lgpl | lesser general public | gnu lesser general public license
name | lgpl | library general public | gnu library general public license
name | lgpl-3.0 | lesser general public | gnu lesser general public license (?:v|version |v )?3(?: 0)?
name | lgpl-2.1 | lesser general public | gnu lesser general public license (?:v|version |v )?2 1
name | lgpl-3.0 | lgplv3 | (?:gnu )?lgplv3
name | lgpl-3.0 | lgpl | (?:gnu )?lgpl (?:v3|version 3|3)(?: 0)?
name | lgpl-2.1 | lgplv2 1 | (?:gnu )?lgplv2 1
name | lgpl-2.1 | lgpl | (?:gnu )?lgpl (?:v2|version 2|2) 1
name | agpl-3.0 | affero general public | gnu affero general public license(?: (?:v|version |v )?3(?: 0)?)?
name | agpl-3.0 | agplv3 | (?:gnu )?agplv3
name | agpl-3.0 | agpl | (?:gnu )?agpl (?:v3|version 3|3)(?: 0)?
name | gfdl | free documentation license | gnu free documentation license(?: (?:v|version |v )?1 [123])?
name | mpl-2.0 | mozilla public license | mozilla public license (?:v|version |v )?2(?: 0)?
name | mpl-1.1 | mozilla public license | mozilla public license (?:v|version |v )?1 1
name | mpl | mozilla public license | mozilla public license
name | epl-2.0 | eclipse public license | eclipse public license (?:v|version |v )?2(?: 0)?
name | epl-1.0 | eclipse public license | eclipse public license (?:v|version |v )?1(?: 0)?
name | epl | eclipse public license | eclipse public license
name | cddl-1.0 | distribution license | common development and distribution license(?: (?:v|version |v )?1(?: 0)?)?
name | zlib | zlib license | (?:the )?zlib license
name | zlib | zlib libpng | zlib libpng license
name | bsl-1.0 | boost software license | boost software license(?: (?:v|version |v )?1(?: 0)?)?
name | busl-1.1 | business source license | business source license(?: (?:v|version |v )?1 1)?
name | sspl-1.0 | server side public license | server side public license(?: (?:v|version |v )?1)?
name | elastic-2.0 | elastic license | elastic license (?:v|version |v )?2(?: 0)?
name | elastic | elastic license | elastic license
name | commons-clause | commons clause | commons clause(?: license)?
name | unlicense | the unlicense | the unlicense
name | wtfpl | wtfpl | wtfpl
name | wtfpl | fuck you want | do what the fuck you want to public license
name | cc0-1.0 | cc0 | cc0(?: 1 0)?(?: universal)?
name | cc-by-4.0 | cc by 4 0 | cc by 4 0
name | cc-by-3.0 | cc by 3 0 | cc by 3 0
name | cc-by-2.0 | cc by 2 0 | cc by 2 0
name | cc-by-nc | cc by nc | cc by nc
name | cc-by-nc-4.0 | cc by nc | cc by nc 4 0
name | cc-by-nc-3.0 | cc by nc | cc by nc 3 0
name | cc-by-nc-sa | cc by nc sa | cc by nc sa
name | cc-by-nc-sa-4.0 | cc by nc sa | cc by nc sa 4 0
name | cc-by-nc-nd | cc by nc nd | cc by nc nd
name | cc-by-nc-nd-4.0 | cc by nc nd | cc by nc nd 4 0
name | cc-by-sa | cc by sa | cc by sa
name | cc-by-sa-4.0 | cc by sa | cc by sa 4 0
name | cc-by-sa-3.0 | cc by sa | cc by sa 3 0
name | cc-by-nd | cc by nd | cc by nd
name | cc-by-nd-4.0 | cc by nd | cc by nd 4 0
name | cc-by-sa | creative commons | creative commons attribution share ?alike
name | cc-by-nc | creative commons | creative commons attribution non ?commercial
name | cc-by-nd | creative commons | creative commons attribution no ?deriv(?:atives|s)
name | cc-by-nc-sa | creative commons | creative commons attribution non ?commercial share ?alike
name | cc-by-nc-nd | creative commons | creative commons attribution non ?commercial no ?deriv(?:atives|s)
name | cc-by | creative commons | creative commons attribution
name | cc | creative commons | creative commons licen[cs]e
name | artistic-2.0 | artistic license | artistic license (?:v|version |v )?2(?: 0)?
name | artistic-1.0 | artistic license | (?:perl )?artistic license
name | ofl-1.1 | open font license | (?:sil )?open font license(?: (?:v|version |v )?1 1)?
name | python-2.0 | python software foundation | python software foundation license(?: (?:v|version |v )?2)?
name | postgresql | postgresql | postgresql licen[cs]e
name | openssl | openssl license | openssl license
name | ncsa | ncsa | (?:university of illinois )?ncsa open source license
name | ruby | ruby license | ruby license
name | php-3.01 | php license | php license(?: (?:v|version |v )?3 01)?
name | vim | vim license | vim license
name | beerware | beerware | beerware(?: license)?
name | beerware | beer ware | beer ware(?: license)?
name | eupl | european union public | european union public licen[cs]e
name | eupl-1.2 | european union public | european union public licen[cs]e (?:v|version |v )?1 2
name | ms-pl | microsoft public license | microsoft public license(?: ms pl)?
name | ms-rl | microsoft reciprocal license | microsoft reciprocal license(?: ms rl)?
name | afl-3.0 | academic free license | academic free license(?: (?:v|version |v )?3(?: 0)?)?
name | osl-3.0 | open software license | open software license(?: (?:v|version |v )?3(?: 0)?)?
name | upl-1.0 | universal permissive license | universal permissive license(?: (?:v|version |v )?1(?: 0)?)?
name | mulanpsl-2.0 | mulan permissive | mulan permissive software license(?: (?:v|version |v )?2)?
name | odbl-1.0 | open database license | (?:odc )?open database license
name | odc-by-1.0 | open data commons | open data commons attribution license
name | pddl-1.0 | public domain dedication | public domain dedication and license
name | cecill-2.1 | cecill | cecill(?: (?:v|version |v )?2 1)?
name | qpl-1.0 | q public license | q public license
name | ipl-1.0 | ibm public license | ibm public license
name | cpl-1.0 | common public license | common public license(?: (?:v|version |v )?1(?: 0)?)?
name | apsl-2.0 | apple public source | apple public source license
name | ofl-1.0 | open font license | open font license (?:v|version |v )?1 0
name | openrail | openrail | (?:creativeml |bigscience |bigcode )?openrail(?: m)?(?: license)?
name | llama | llama | llama [234](?: [0-9])? community license
name | gemma | gemma terms | gemma terms of use
"""


class Rule(NamedTuple):
    kind: str
    label: str
    keyword: str
    pattern: str

    @property
    def gate(self) -> str:
        """The word of the keyword by which texts are sorted out first: the longest one."""
        return max(self.keyword.split(), key=len)


def parse(text: str) -> list[Rule]:
    return [Rule(*(x.strip() for x in line.split(" | ", 3))) for line in text.splitlines() if line.strip()]


RULES = parse(RULES_TEXT)
#: The base phrases and their labels.
BASE = [Rule("base", label, phrase, phrase) for phrase, label in (
    ("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))]
