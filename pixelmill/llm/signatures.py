"""Signatures of licenses, as regexes over lower-case words with one space between them.

Each line: label, keyword, further keywords of which a match holds one at least ("a|b"), regex. Every match holds the
keyword as a word; the scanner uses both columns to pass over rules that cannot match.
"""

# Machine-readable tags, the surest signs.
TAGS = [
    ("mit", "mit", "spdx", "spdx license identifier mit"),
    ("mit-0", "0", "spdx", "spdx license identifier mit 0"),
    ("isc", "isc", "spdx", "spdx license identifier isc"),
    ("apache-1.1", "apache", "spdx", "spdx license identifier apache 1 1"),
    ("apache-2.0", "apache", "spdx", "spdx license identifier apache 2 0"),
    ("apache-2.0-llvm", "llvm", "spdx", "spdx license identifier apache 2 0 with llvm exception"),
    ("0bsd", "0bsd", "spdx", "spdx license identifier 0bsd"),
    ("bsd-1-clause", "bsd", "spdx", "spdx license identifier bsd 1 clause"),
    ("bsd-2-clause", "bsd", "spdx", "spdx license identifier bsd 2 clause(?: (?:freebsd|patent|views))?"),
    ("bsd-3-clause", "bsd", "spdx", "spdx license identifier bsd 3 clause(?: (?:clear|lbnl|attribution))?"),
    ("bsd-4-clause", "bsd", "spdx", "spdx license identifier bsd 4 clause(?: uc)?"),
    ("gpl-1.0", "gpl", "spdx", "spdx license identifier gpl 1 0(?: only| or later)?"),
    ("gpl-2.0", "gpl", "spdx", "spdx license identifier gpl 2 0(?: only| or later)?"),
    ("gpl-2.0-classpath", "classpath", "spdx", "spdx license identifier gpl 2 0(?: only| or later)? with classpath exception"),
    ("gpl-2.0-linux-syscall", "syscall", "spdx", "spdx license identifier gpl 2 0(?: only| or later)? with linux syscall note"),
    ("gpl-3.0", "gpl", "spdx", "spdx license identifier gpl 3 0(?: only| or later)?"),
    ("gpl-3.0-gcc", "gcc", "spdx", "spdx license identifier gpl 3 0(?: only| or later)? with gcc exception"),
    ("lgpl-2.0", "lgpl", "spdx", "spdx license identifier lgpl 2 0(?: only| or later)?"),
    ("lgpl-2.1", "lgpl", "spdx", "spdx license identifier lgpl 2 1(?: only| or later)?"),
    ("lgpl-3.0", "lgpl", "spdx", "spdx license identifier lgpl 3 0(?: only| or later)?"),
    ("agpl-3.0", "agpl", "spdx", "spdx license identifier agpl 3 0(?: only| or later)?"),
    ("gfdl-1.3", "gfdl", "spdx", "spdx license identifier gfdl 1 [123](?: only| or later)?"),
    ("mpl-1.1", "mpl", "spdx", "spdx license identifier mpl 1 1"),
    ("mpl-2.0", "mpl", "spdx", "spdx license identifier mpl 2 0(?: no copyleft exception)?"),
    ("epl-1.0", "epl", "spdx", "spdx license identifier epl 1 0"),
    ("epl-2.0", "epl", "spdx", "spdx license identifier epl 2 0"),
    ("eupl-1.1", "eupl", "spdx", "spdx license identifier eupl 1 1"),
    ("eupl-1.2", "eupl", "spdx", "spdx license identifier eupl 1 2"),
    ("cddl-1.0", "cddl", "spdx", "spdx license identifier cddl 1 [01]"),
    ("cc0-1.0", "cc0", "spdx", "spdx license identifier cc0 1 0"),
    ("cc-by-4.0", "cc", "spdx", "spdx license identifier cc by [234] 0"),
    ("cc-by-sa-4.0", "sa", "spdx", "spdx license identifier cc by sa [234] 0"),
    ("cc-by-nc-4.0", "nc", "spdx", "spdx license identifier cc by nc [234] 0"),
    ("cc-by-nd-4.0", "nd", "spdx", "spdx license identifier cc by nd [234] 0"),
    ("unlicense", "unlicense", "spdx", "spdx license identifier unlicense"),
    ("wtfpl", "wtfpl", "spdx", "spdx license identifier wtfpl"),
    ("zlib", "zlib", "spdx", "spdx license identifier zlib"),
    ("boost-1.0", "bsl", "spdx", "spdx license identifier bsl 1 0"),
    ("busl-1.1", "busl", "spdx", "spdx license identifier busl 1 1"),
    ("artistic-2.0", "artistic", "spdx", "spdx license identifier artistic [12] 0"),
    ("ofl-1.1", "ofl", "spdx", "spdx license identifier ofl 1 [01]"),
    ("upl-1.0", "upl", "spdx", "spdx license identifier upl 1 0"),
    ("ms-pl", "ms", "spdx", "spdx license identifier ms (?:pl|rl)"),
    ("postgresql", "postgresql", "spdx", "spdx license identifier postgresql"),
    ("python-2.0", "python", "spdx", "spdx license identifier python 2 0"),
    ("psf-2.0", "psf", "spdx", "spdx license identifier psf 2 0"),
    ("mulanpsl-2.0", "mulanpsl", "spdx", "spdx license identifier mulanpsl 2 0"),
]

# Notices that put a file or work under a license.
NOTICES = [
    ("mit", "mit", "licensed|released|distributed|available", "(?:licensed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?mit(?: licen[cs]e)?"),
    ("mit", "mit", "source", "use of this source code is governed by an mit style license"),
    ("mit", "expat", "licensed|released|distributed", "(?:licensed|released|distributed) under (?:the )?(?:terms of (?:the )?)?expat(?: licen[cs]e)?"),
    ("isc", "isc", "licensed|released|distributed", "(?:licensed|released|distributed) under (?:the )?(?:terms of (?:the )?)?isc(?: licen[cs]e)?"),
    ("apache-2.0", "apache", "licensed", "licensed under (?:the )?(?:terms of (?:the )?)?apache(?: software)? licen[cs]e(?: version)? 2 0"),
    ("apache-2.0", "apache", "released|distributed|available", "(?:released|distributed|available) under (?:the )?(?:terms of (?:the )?)?apache(?: software)?(?: licen[cs]e)?(?: version)? 2(?: 0)?"),
    ("apache-2.0", "apache", "licensed", "licensed to the apache software foundation asf under one or more contributor license agreements"),
    ("apache-2.0", "asf", "license", "the asf licenses this file to you under the apache license version 2 0 the license"),
    ("apache-2.0", "compliance", "license", "you may not use this file except in compliance with the license"),
    ("apache-2.0", "obtain", "license", "you may obtain a copy of the license at (?:http|https) www apache org licenses license 2 0"),
    ("apache-2.0-mit", "apache", "licensed", "dual licensed under (?:the )?(?:apache 2 0 and mit|mit and apache 2 0)(?: licenses?)?"),
    ("apache-2.0-mit", "apache", "licensed", "licensed under either of (?:the )?apache license version 2 0 or (?:the )?mit license"),
    ("bsd", "bsd", "source", "use of this source code is governed by a bsd style license(?: that can be found in the license file)?"),
    ("bsd", "bsd", "licensed|released|distributed", "(?:licensed|released|distributed) under (?:the )?(?:terms of (?:the )?)?bsd(?: style)? licen[cs]e"),
    ("bsd-2-clause", "bsd", "licensed|released|distributed", "(?:licensed|released|distributed) under (?:the )?(?:simplified bsd|bsd 2 clause|2 clause bsd)(?: licen[cs]e)?"),
    ("bsd-2-clause", "freebsd", "licensed|released|distributed", "(?:licensed|released|distributed) under (?:the )?freebsd licen[cs]e"),
    ("bsd-3-clause", "bsd", "licensed|released|distributed", "(?:licensed|released|distributed) under (?:the )?(?:new bsd|revised bsd|modified bsd|bsd 3 clause|3 clause bsd)(?: licen[cs]e)?"),
    ("gpl", "gnu", "redistribute", "you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl-1.0", "gpl", "licensed|released|distributed", "(?:licensed|released|distributed) under (?:the )?gpl(?: version)? v?1(?: 0)?"),
    ("gpl-2.0", "gpl", "licensed|released|distributed|available", "(?:licensed|released|distributed|available) under (?:the )?(?:gnu )?gpl(?: version)? v?2(?: 0)?(?: or later)?"),
    ("gpl-2.0", "gplv2", "licensed|released|distributed|available", "(?:licensed|released|distributed|available) under (?:the )?(?:gnu )?gplv2(?: 0)?"),
    ("gpl-2.0", "gnu", "redistribute", "redistribute it and or modify it under the terms of the gnu general public license(?: as published by the free software foundation)? either version 2 of the license"),
    ("gpl-2.0", "gnu", "license", "under the terms of the gnu general public license version 2(?: only)?(?: as published by the free software foundation)?"),
    ("gpl-3.0", "gpl", "licensed|released|distributed|available", "(?:licensed|released|distributed|available) under (?:the )?(?:gnu )?gpl(?: version)? v?3(?: 0)?(?: or later)?"),
    ("gpl-3.0", "gplv3", "licensed|released|distributed|available", "(?:licensed|released|distributed|available) under (?:the )?(?:gnu )?gplv3(?: 0)?"),
    ("gpl-3.0", "gnu", "redistribute", "redistribute it and or modify it under the terms of the gnu general public license(?: as published by the free software foundation)? either version 3 of the license"),
    ("gpl-3.0", "gnu", "license", "under the terms of the gnu general public license version 3(?: only)?(?: as published by the free software foundation)?"),
    ("gpl", "gnu", "license", "you should have received a copy of the gnu general public license along with this (?:program|software|library|file|package)"),
    ("gpl", "gpl", "licensed|released|distributed|available", "(?:licensed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?(?:gnu )?gpl"),
    ("gpl-classpath", "classpath", "license", "subject to the classpath exception as provided (?:by oracle )?in the license file that accompanied this code"),
    ("lgpl", "lesser", "redistribute", "you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("lgpl-2.0", "library", "redistribute", "you can redistribute it and or modify it under the terms of the gnu library general public license"),
    ("lgpl-2.1", "lesser", "version", "gnu lesser general public license(?: as published by the free software foundation)? either version 2 1 of the license"),
    ("lgpl-2.1", "lgpl", "licensed|released|distributed|available", "(?:licensed|released|distributed|available) under (?:the )?(?:gnu )?lgpl(?: version)? v?2 1"),
    ("lgpl-2.1", "lgplv2", "licensed|released|distributed|available", "(?:licensed|released|distributed|available) under (?:the )?(?:gnu )?lgplv2 1"),
    ("lgpl-3.0", "lesser", "version", "gnu lesser general public license(?: as published by the free software foundation)? either version 3 of the license"),
    ("lgpl-3.0", "lgpl", "licensed|released|distributed|available", "(?:licensed|released|distributed|available) under (?:the )?(?:gnu )?lgpl(?: version)? v?3(?: 0)?"),
    ("lgpl-3.0", "lgplv3", "licensed|released|distributed|available", "(?:licensed|released|distributed|available) under (?:the )?(?:gnu )?lgplv3"),
    ("lgpl", "lesser", "license", "you should have received a copy of the gnu lesser general public license along with this (?:program|software|library)"),
    ("agpl-3.0", "affero", "redistribute", "you can redistribute it and or modify it under the terms of the gnu affero general public license"),
    ("agpl-3.0", "agplv3", "licensed|released|distributed|available", "(?:licensed|released|distributed|available) under (?:the )?(?:gnu )?agplv3"),
    ("agpl-3.0", "agpl", "licensed|released|distributed|available", "(?:licensed|released|distributed|available) under (?:the )?(?:gnu )?agpl(?: version)? v?3(?: 0)?"),
    ("agpl-3.0", "affero", "license", "you should have received a copy of the gnu affero general public license along with this program"),
    ("gfdl", "documentation", "permission", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("gfdl", "invariant", "cover", "with no invariant sections no front cover texts and no back cover texts"),
    ("mpl-1.1", "mozilla", "contents", "the contents of this file are subject to the mozilla public license version 1 1"),
    ("mpl-2.0", "mozilla", "source", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-2.0", "mpl", "file", "if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("mpl-2.0", "mpl", "licensed|released|distributed", "(?:licensed|released|distributed) under (?:the )?mpl(?: version)? 2(?: 0)?"),
    ("mpl-tri", "mpl", "gpl", "version mpl 1 1 gpl 2 0 lgpl 2 1"),
    ("epl-1.0", "eclipse", "accompanying", "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0"),
    ("epl-2.0", "eclipse", "accompanying", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0"),
    ("epl-2.0", "secondary", "licenses", "this source code may also be made available under the following secondary licenses"),
    ("eupl-1.2", "eupl", "licensed|released|distributed", "(?:licensed|released|distributed) under (?:the )?eupl(?: version)?(?: v?1 2)?(?: or later)?"),
    ("eupl-1.2", "european", "licensed|released|distributed", "(?:licensed|released|distributed) under (?:the )?european union public licen[cs]e(?: v?1 2)?"),
    ("cddl-1.0", "cddl", "contents", "the contents of this file are subject to the terms of either the gnu general public license version 2 only gpl or the common development and distribution license cddl"),
    ("cddl-1.0", "common", "contents", "the contents of this file are subject to the terms of the common development and distribution license"),
    ("cddl-1.0", "cddl", "header", "do not alter or remove copyright notices or this cddl header"),
    ("cpl-1.0", "common", "accompanies", "made available under the terms of the common public license v1 0 which accompanies this distribution"),
    ("artistic", "perl", "redistribute|licensed|terms", "(?:you can redistribute it and or modify it|licensed) under the same terms as perl(?: 5)?(?: itself)?"),
    ("artistic-2.0", "artistic", "licensed|released|distributed", "(?:licensed|released|distributed) under (?:the )?artistic license(?: version)? 2(?: 0)?"),
    ("zlib", "zlib", "licensed|released|distributed", "(?:licensed|released|distributed) under (?:the )?zlib(?: libpng)? licen[cs]e"),
    ("boost-1.0", "boost", "distributed|licensed", "(?:distributed|licensed) under the boost software license version 1 0"),
    ("unlicense", "unlicense", "licensed|released|distributed", "(?:licensed|released|distributed) under (?:the )?unlicense"),
    ("wtfpl", "wtfpl", "licensed|released|distributed", "(?:licensed|released|distributed) under (?:the )?(?:terms of (?:the )?)?wtfpl"),
    ("cc0-1.0", "cc0", "licensed|released|dedicated|waived", "(?:licensed|released|dedicated|waived) (?:under|to the public domain under|using) (?:the )?(?:creative commons )?cc0(?: 1 0)?"),
    ("cc0-1.0", "extent", "waived", "to the extent possible under law the author has waived all copyright and related or neighboring rights"),
    ("cc-by", "creative", "licensed", "licensed under (?:a |the )?creative commons attribution(?: [234] 0)?(?: international| unported| generic)? license"),
    ("cc-by-sa", "creative", "licensed", "licensed under (?:a |the )?creative commons attribution share ?alike(?: [234] 0)?(?: international| unported| generic)? license"),
    ("cc-by-nc", "creative", "licensed", "licensed under (?:a |the )?creative commons attribution non ?commercial(?: [234] 0)?(?: international| unported| generic)? license"),
    ("cc-by-nd", "creative", "licensed", "licensed under (?:a |the )?creative commons attribution no ?deriv(?:s|atives)(?: [234] 0)?(?: international| unported| generic)? license"),
    ("cc-by-nc-sa", "creative", "licensed", "licensed under (?:a |the )?creative commons attribution non ?commercial share ?alike(?: [234] 0)?(?: international| unported| generic)? license"),
    ("cc-by-nc-nd", "creative", "licensed", "licensed under (?:a |the )?creative commons attribution non ?commercial no ?deriv(?:s|atives)(?: [234] 0)?(?: international| unported| generic)? license"),
    ("cc", "creativecommons", "licenses", "(?:http|https) creativecommons org licenses by(?: nc| sa| nd| nc sa| nc nd)? [1234] 0"),
    ("cc0-1.0", "creativecommons", "publicdomain", "(?:http|https) creativecommons org publicdomain zero 1 0"),
    ("ofl-1.1", "font", "licensed", "this font software is licensed under the sil open font license version 1 1"),
    ("ofl-1.1", "font", "licensed|released", "(?:licensed|released) under (?:the )?(?:sil )?open font(?: licen[cs]e)?(?: version)? 1 1(?: licen[cs]e)?"),
    ("odbl-1.0", "database", "available|licensed", "(?:made available|licensed) under the open (?:data commons open )?database license"),
    ("python-2.0", "psf", "licensed", "licensed to psf under a contributor agreement"),
    ("php-3.01", "php", "subject", "this source file is subject to version 3 01? of the php license"),
    ("postgresql", "postgresql", "licensed|released|distributed", "(?:licensed|released|distributed) under (?:the )?postgresql licen[cs]e"),
    ("ruby", "ruby", "licensed|distributed|terms", "(?:licensed|distributed|terms) (?:under )?(?:the )?(?:same )?(?:terms )?as ruby"),
    ("ms-pl", "microsoft", "licensed|released|distributed", "(?:licensed|released|distributed) under (?:the )?microsoft public license"),
    ("ms-rl", "reciprocal", "licensed|released|distributed", "(?:licensed|released|distributed) under (?:the )?microsoft reciprocal license"),
    ("busl-1.1", "business", "governed|licensed", "(?:use of this software is governed by|licensed under) the business source license(?: 1 1)?(?: included in the)?"),
    ("busl-1.1", "change", "version", "on the date specified in the change date use of this software will be governed by the change license version"),
    ("sspl-1.0", "server", "redistribute|licensed", "(?:redistribute it and or modify it|licensed) under the (?:terms of the )?server side public license version 1"),
    ("elastic-2.0", "elastic", "licensed", "licensed under (?:one or more contributor license agreements licensed under )?the elastic license(?: 2 0)?"),
    ("upl-1.0", "universal", "licensed", "licensed under the universal permissive license(?: v)? 1 0"),
    ("ncsa", "illinois", "distributed|licensed", "(?:distributed|licensed) under the university of illinois(?: ncsa)? open source license"),
    ("ncsa", "ncsa", "distributed|licensed", "(?:distributed|licensed) under the ncsa(?: open source)? license"),
    ("public-domain", "domain", "placed|released|dedicated", "(?:placed|released|dedicated) (?:in|into|to) the public domain"),
    ("public-domain", "domain", "hereby", "hereby (?:placed in|released into|dedicated to) the public domain"),
    ("proprietary", "confidential", "proprietary", "(?:this file is )?(?:proprietary and confidential|confidential and proprietary)"),
    ("proprietary", "reserved", "copyright|rights", "unauthori[sz]ed copying of this file via any medium is strictly prohibited(?: proprietary and confidential)? all rights reserved"),
    ("mulanpsl-2.0", "mulan", "licensed", "licensed under (?:the )?mulan psl v2"),
]

# Sentences of the licenses' own texts.
BODIES = [
    ("mit", "hereby", "permission", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", "copyright", "permission", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", "noninfringement", "warranties", "including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("isc", "hereby", "permission", "permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", "disclaims", "warranties", "the software is provided as is and the author disclaims all warranties with regard to this software"),
    ("boost-1.0", "hereby", "permission", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software"),
    ("boost-1.0", "executable", "copies", "unless such copies or derivative works are solely in the form of machine executable object code generated by a source language processor"),
    ("x11", "advertising", "consortium", "the name of the x consortium shall not be used in advertising or otherwise to promote the sale"),
    ("hpnd", "advertising", "permission", "not be used in advertising or publicity pertaining to distribution of the software without specific written prior permission"),
    ("bsd", "forms", "redistribution", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "redistributions", "copyright", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "redistributions", "copyright", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd-3-clause", "endorse", "permission", "endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-4-clause", "acknowledgement", "advertising", "all advertising materials mentioning features or use of this software must display the following acknowledgement"),
    ("bsd-clear", "patent", "license", "no express or implied licenses to any party s patent rights are granted by this license"),
    ("apache-1.1", "acknowledgment", "apache", "this product includes software developed by the apache software foundation acknowledgment"),
    ("apache-1.1", "apache", "endorse", "the names apache and apache software foundation must not be used to endorse or promote products"),
    ("apache-2.0", "unless", "distributed", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("apache-2.0", "perpetual", "license", "each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license"),
    ("apache-2.0", "terms", "reproduction", "terms and conditions for use reproduction and distribution"),
    ("gpl", "everyone", "license", "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed"),
    ("gpl", "hope", "distributed", "this program is distributed in the hope that it will be useful but without any warranty"),
    ("gpl-2.0", "freedom", "licenses", "the licenses for most software are designed to take away your freedom to share and change it"),
    ("gpl-3.0", "copyleft", "license", "the gnu general public license is a free copyleft license for software and other kinds of works"),
    ("gpl-3.0", "tivoization", "installation", "installation information for tivoization"),
    ("lgpl", "hope", "distributed", "this library is distributed in the hope that it will be useful but without any warranty"),
    ("lgpl-3.0", "incorporates", "license", "this version of the gnu lesser general public license incorporates the terms and conditions of version 3 of the gnu general public license"),
    ("agpl-3.0", "remotely", "network", "offer all users interacting with it remotely through a computer network"),
    ("mpl-2.0", "covered", "license", "covered software is provided under this license on an as is basis"),
    ("epl", "accompanying", "license", "the accompanying program is provided under the terms of this (?:common|eclipse) public license agreement any use reproduction or distribution of the program"),
    ("zlib", "liable", "warranty", "this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("zlib", "misrepresented", "origin", "the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("zlib", "altered", "source", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("unlicense", "unencumbered", "released", "this is free and unencumbered software released into the public domain"),
    ("unlicense", "anyone", "distribute", "anyone is free to copy modify publish use compile sell or distribute this software"),
    ("cc0-1.0", "affirmer", "waives", "affirmer hereby overtly fully permanently irrevocably and unconditionally waives"),
    ("cc-by", "licensor", "license", "subject to the terms and conditions of this public license the licensor hereby grants you a worldwide royalty free"),
    ("ofl-1.1", "font", "sold", "neither the font software nor any of its individual components in original or modified versions may be sold by itself"),
    ("ofl-1.1", "reserved", "font", "no modified version of the font software may use the reserved font name"),
    ("artistic-1.0", "intent", "package", "the intent of this document is to state the conditions under which a package may be copied"),
    ("artistic-2.0", "package", "license", "this license establishes the terms under which a given free software package may be copied modified distributed"),
    ("python-2.0", "psf", "license", "psf hereby grants licensee a nonexclusive royalty free world wide license"),
    ("php-3.01", "php", "products", "products derived from this software may not be called php nor may php appear in their name"),
    ("postgresql", "documentation", "permission", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    ("openssl", "openssl", "includes", "this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("ms-pl", "contributors", "license", "this license does not grant you rights to use any contributors name logo or trademarks"),
    ("sspl-1.0", "service", "source", "if you make the functionality of the program or a modified version available to third parties as a service you must make the service source code available"),
    ("elastic-2.0", "managed", "software", "you may not provide the software to third parties as a hosted or managed service"),
    ("busl-1.1", "production", "licensor", "the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work"),
    ("beerware", "beer", "license", "the beer ware license"),
    ("json", "evil", "software", "the software shall be used for good not evil"),
    ("jpeg", "jpeg", "software", "this software is based in part on the work of the independent jpeg group"),
    ("curl", "holder", "advertising", "the name of a copyright holder shall not be used in advertising or otherwise to promote the sale"),
    ("vim", "vim", "license", "there are no restrictions on distributing unmodified copies of vim except that they must include this license text"),
    ("unicode", "unicode", "permission", "permission is hereby granted free of charge to any person obtaining a copy of the unicode data files"),
    ("icu", "icu", "license", "icu license icu 1 8 1 and later"),
    ("w3c", "w3c", "notice", "w3c software (?:and document )?notice and license"),
    ("ntp", "fee", "permission", "permission to use copy modify and distribute this software and its documentation for any purpose with or without fee is hereby granted"),
]

# Names of licenses as they stand in running text.
NAMES = [
    ("mit", "mit", "license|licence|licensing|licenses", "(?:the )?mit(?: x11)? licen[cs]e"),
    ("mit", "expat", "license|licence", "expat licen[cs]e"),
    ("mit-0", "mit", "license|licence", "mit no attribution licen[cs]e|mit 0 licen[cs]e"),
    ("x11", "x11", "license|licence", "x11 licen[cs]e"),
    ("isc", "isc", "license|licence", "isc licen[cs]e"),
    ("apache", "apache", "license|licence", "apache(?: software)? licen[cs]e"),
    ("apache-1.1", "apache", "license|licence", "apache(?: software)? licen[cs]e(?: version)? 1 1"),
    ("apache-2.0", "apache", "license|licence", "apache(?: software)? licen[cs]e(?: version)? v?2(?: 0)?|apache(?: version)? 2(?: 0)? licen[cs]e"),
    ("bsd", "bsd", "license|licence|licenses|licences", "(?:berkeley software distribution )?bsd(?: style)? licen[cs]es?"),
    ("0bsd", "bsd", "license|licence", "(?:zero clause bsd|bsd zero clause) licen[cs]e"),
    ("bsd-2-clause", "bsd", "license|licence", "(?:simplified bsd|bsd 2 clause|2 clause bsd|two clause bsd) licen[cs]e"),
    ("bsd-2-clause", "freebsd", "license|licence", "freebsd licen[cs]e"),
    ("bsd-3-clause", "bsd", "license|licence", "(?:new bsd|revised bsd|modified bsd|bsd 3 clause|3 clause bsd|three clause bsd) licen[cs]e"),
    ("bsd-4-clause", "bsd", "license|licence", "(?:original bsd|old bsd|bsd 4 clause|4 clause bsd) licen[cs]e"),
    ("gpl", "gnu", "license|licence", "gnu (?:general public|gpl) licen[cs]e"),
    ("gpl-1.0", "gplv1", "license|licence", "gplv1 licen[cs]e"),
    ("gpl-1.0", "gpl", "license|licence|version", "gpl version 1(?: 0)?(?: licen[cs]e)?|gpl v?1(?: 0)? licen[cs]e"),
    ("gpl-2.0", "gplv2", "license|licence", "gplv2(?: 0)? licen[cs]e"),
    ("gpl-2.0", "gpl", "license|licence|version", "gpl version 2(?: 0)?(?: licen[cs]e)?|gpl v?2(?: 0)? licen[cs]e"),
    ("gpl-2.0", "general", "license|licence", "general public licen[cs]e(?: version)? v?2(?: 0)?(?: or later)?"),
    ("gpl-3.0", "gplv3", "license|licence", "gplv3(?: 0)? licen[cs]e"),
    ("gpl-3.0", "gpl", "license|licence|version", "gpl version 3(?: 0)?(?: licen[cs]e)?|gpl v?3(?: 0)? licen[cs]e"),
    ("gpl-3.0", "general", "license|licence", "general public licen[cs]e(?: version)? v?3(?: 0)?(?: or later)?"),
    ("lgpl", "lesser", "license|licence", "(?:gnu )?lesser general public licen[cs]e"),
    ("lgpl-2.0", "library", "license|licence", "(?:gnu )?library general public licen[cs]e"),
    ("lgpl-2.1", "lesser", "license|licence", "lesser general public licen[cs]e(?: version)? v?2 1"),
    ("lgpl-2.1", "lgplv2", "license|licence", "lgplv2 1 licen[cs]e"),
    ("lgpl-2.1", "lgpl", "license|licence", "lgpl(?: version)? v?2 1 licen[cs]e"),
    ("lgpl-3.0", "lesser", "license|licence", "lesser general public licen[cs]e(?: version)? v?3(?: 0)?"),
    ("lgpl-3.0", "lgplv3", "license|licence", "lgplv3(?: 0)? licen[cs]e"),
    ("lgpl-3.0", "lgpl", "license|licence", "lgpl(?: version)? v?3(?: 0)? licen[cs]e"),
    ("agpl", "affero", "license|licence", "(?:gnu )?affero general public licen[cs]e"),
    ("agpl-3.0", "affero", "license|licence", "affero general public licen[cs]e(?: version)? v?3(?: 0)?"),
    ("agpl-3.0", "agplv3", "license|licence", "agplv3(?: 0)? licen[cs]e"),
    ("gfdl", "documentation", "license|licence", "(?:gnu )?free documentation licen[cs]e"),
    ("mpl", "mozilla", "license|licence", "mozilla public licen[cs]e"),
    ("mpl-1.1", "mozilla", "license|licence", "mozilla public licen[cs]e(?: version| v)? 1 1"),
    ("mpl-2.0", "mozilla", "license|licence", "mozilla public licen[cs]e(?: version| v)? 2(?: 0)?"),
    ("npl", "netscape", "license|licence", "netscape public licen[cs]e"),
    ("epl", "eclipse", "license|licence", "eclipse public licen[cs]e"),
    ("epl-1.0", "eclipse", "license|licence", "eclipse public licen[cs]e(?: version)? v?1(?: 0)?"),
    ("epl-2.0", "eclipse", "license|licence", "eclipse public licen[cs]e(?: version)? v?2(?: 0)?"),
    ("edl-1.0", "eclipse", "license|licence", "eclipse distribution licen[cs]e(?: v?1 0)?"),
    ("eupl-1.1", "european", "license|licence", "european union public licen[cs]e(?: version)? v?1 1"),
    ("eupl-1.2", "european", "license|licence", "european union public licen[cs]e(?: version)? v?1 2"),
    ("cddl", "distribution", "license|licence", "common development and distribution licen[cs]e(?: version)?(?: 1 [01])?"),
    ("cpl-1.0", "common", "license|licence", "common public licen[cs]e(?: version)?(?: 1 0)?"),
    ("ipl-1.0", "ibm", "license|licence", "ibm public licen[cs]e(?: version)?(?: 1 0)?"),
    ("apsl", "apple", "license|licence", "apple public source licen[cs]e"),
    ("osl-3.0", "open", "license|licence", "open software licen[cs]e(?: version)?(?: 3 0)?"),
    ("afl-3.0", "academic", "license|licence", "academic free licen[cs]e(?: version)?(?: 3 0)?"),
    ("artistic", "artistic", "license|licence", "artistic licen[cs]e"),
    ("artistic-2.0", "artistic", "license|licence", "artistic licen[cs]e(?: version)? 2(?: 0)?"),
    ("zlib", "zlib", "license|licence", "zlib(?: libpng)? licen[cs]e"),
    ("libpng", "png", "license|licence", "png reference library licen[cs]e"),
    ("libpng", "libpng", "license|licence", "libpng licen[cs]e"),
    ("boost-1.0", "boost", "license|licence", "boost(?: software)? licen[cs]e"),
    ("unlicense", "unlicense", "license|licence", "(?:the )?unlicense licen[cs]e"),
    ("wtfpl", "wtfpl", "license|licence", "wtfpl licen[cs]e"),
    ("cc0-1.0", "cc0", "license|licence|dedication|universal", "cc0(?: 1 0)?(?: universal)? (?:licen[cs]e|public domain dedication)|cc0 1 0 universal"),
    ("cc-by", "creative", "attribution", "creative commons attribution(?: [234] 0)?(?: licen[cs]e)?"),
    ("cc-by-sa", "creative", "attribution", "creative commons attribution share ?alike(?: [234] 0)?(?: licen[cs]e)?"),
    ("cc-by-nc", "creative", "attribution", "creative commons attribution non ?commercial(?: [234] 0)?(?: licen[cs]e)?"),
    ("cc-by-4.0", "cc", "license|licence", "cc by(?: 4 0)? licen[cs]e"),
    ("cc-by-sa-4.0", "cc", "license|licence", "cc by sa(?: 4 0)? licen[cs]e"),
    ("cc-by-nc-4.0", "cc", "license|licence", "cc by nc(?: 4 0)? licen[cs]e"),
    ("cc-by-nd-4.0", "cc", "license|licence", "cc by nd(?: 4 0)? licen[cs]e"),
    ("cc-by-nc-sa-4.0", "cc", "license|licence", "cc by nc sa(?: 4 0)? licen[cs]e"),
    ("cc-by-nc-nd-4.0", "cc", "license|licence", "cc by nc nd(?: 4 0)? licen[cs]e"),
    ("ofl-1.1", "font", "license|licence", "(?:sil )?open font licen[cs]e(?: version)?(?: 1 1)?"),
    ("ofl-1.1", "ofl", "license|licence", "(?:sil )?ofl(?: 1 1)? licen[cs]e"),
    ("odbl-1.0", "database", "license|licence", "open (?:data commons open )?database licen[cs]e"),
    ("pddl-1.0", "dedication", "license|licence", "public domain dedication and licen[cs]e"),
    ("python-2.0", "python", "license|licence", "python(?: software foundation)? licen[cs]e"),
    ("php-3.01", "php", "license|licence", "php licen[cs]e(?: version)?(?: 3 01)?"),
    ("postgresql", "postgresql", "license|licence", "postgresql licen[cs]e"),
    ("openssl", "openssl", "license|licence", "openssl licen[cs]e"),
    ("ms-pl", "microsoft", "license|licence", "microsoft public licen[cs]e"),
    ("ms-rl", "reciprocal", "license|licence", "microsoft reciprocal licen[cs]e"),
    ("busl-1.1", "business", "license|licence", "business source licen[cs]e(?: 1 1)?"),
    ("sspl-1.0", "server", "license|licence", "server side public licen[cs]e"),
    ("elastic-2.0", "elastic", "license|licence", "elastic licen[cs]e(?: 2 0)?"),
    ("upl-1.0", "universal", "license|licence", "universal permissive licen[cs]e"),
    ("ncsa", "ncsa", "license|licence", "(?:university of illinois )?ncsa(?: open source)? licen[cs]e"),
    ("ecl-2.0", "educational", "license|licence", "educational community licen[cs]e(?: version)?(?: 2 0)?"),
    ("lppl", "latex", "license|licence", "latex project public licen[cs]e"),
    ("qpl", "q", "license|licence", "q public licen[cs]e"),
    ("sleepycat", "sleepycat", "license|licence", "sleepycat licen[cs]e"),
    ("vim", "vim", "license|licence", "vim licen[cs]e"),
    ("w3c", "w3c", "license|licence", "w3c(?: software)? licen[cs]e"),
    ("mulanpsl-2.0", "mulan", "license|licence", "mulan permissive software licen[cs]e(?: version)?(?: 2)?"),
]

# Weak signs.
HINTS = [
    ("mit", "mit", "license|licence", "licen[cs]e(?: is)?(?: the)? mit"),
    ("isc", "isc", "license|licence", "licen[cs]e(?: is)?(?: the)? isc"),
    ("apache-2.0", "apache", "license|licence", "licen[cs]e(?: is)?(?: the)? apache 2(?: 0)?"),
    ("bsd", "bsd", "license|licence", "licen[cs]e(?: is)?(?: the)? bsd"),
    ("gpl", "gpl", "license|licence", "licen[cs]e(?: is)?(?: the)? gpl"),
    ("gpl-2.0", "gplv2", "license|licence", "licen[cs]e(?: is)?(?: the)? gplv2"),
    ("gpl-3.0", "gplv3", "license|licence", "licen[cs]e(?: is)?(?: the)? gplv3"),
    ("lgpl", "lgpl", "license|licence", "licen[cs]e(?: is)?(?: the)? lgpl"),
    ("agpl", "agpl", "license|licence", "licen[cs]e(?: is)?(?: the)? agpl"),
    ("mpl-2.0", "mpl", "license|licence", "licen[cs]e(?: is)?(?: the)? mpl 2 0"),
    ("unlicense", "unlicense", "license|licence", "licen[cs]e(?: is)?(?: the)? unlicense"),
    ("cc0-1.0", "cc0", "license|licence", "licen[cs]e(?: is)?(?: the)? cc0"),
    ("proprietary", "proprietary", "license|licence", "licen[cs]e(?: is)?(?: a)? proprietary|proprietary licen[cs]e"),
    ("public-domain", "domain", "license|licence", "public domain licen[cs]e"),
    ("gpl-compatible", "compatible", "gpl", "gpl compatible"),
]

#: (signatures, priority, confidence), the surest first.
CLASSES = [(TAGS, 4, 1.0), (NOTICES, 3, 0.95), (BODIES, 3, 0.9), (NAMES, 2, 0.8), (HINTS, 1, 0.6)]
