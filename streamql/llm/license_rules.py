"""Ordered signature rules for license scans.

Patterns are written over normalised text: lower case words joined by single spaces, so
"Apache License, Version 2.0" reads "apache license version 2 0". A pattern matches whole
words. A rule is (label, keyword, pattern, relevance); its place in RULES is its priority,
the first being the strongest: tags, then the sentences of license texts and notices, then
names with versions, then bare names and vague hints.

A keyword is a plain substring that every match holds; it gates the pattern. Of KEYWORDS the
first that stands in the fixed words of a pattern is its own.
"""

import re

#: Sentences that only one license (or family) has, and notices by which files name theirs: (label, pattern, relevance).
SENTENCES = [
    # MIT and kin
    ("mit", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", 1.0),
    ("mit", r"to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell", 1.0),
    ("mit", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", 0.95),
    ("mit", r"deal in the software without restriction", 0.9),
    ("mit", r"licen[sc]ed under (?:the )?(?:terms of (?:the )?)?mit", 0.9),
    ("mit", r"(?:released|distributed|available) under (?:the )?(?:terms of (?:the )?)?mit licen[sc]e", 0.95),
    ("mit", r"use of this source code is governed by an? mit style licen[sc]e", 0.95),
    ("mit", r"opensource org licen[sc]es mit", 0.95),
    ("mit-0", r"mit no attribution licen[sc]e|licen[sc]ed under (?:the )?mit no attribution", 0.95),
    ("isc", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", 1.0),
    ("isc", r"permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted", 0.95),
    ("isc", r"licen[sc]ed under (?:the )?(?:terms of (?:the )?)?isc", 0.9),
    ("isc", r"opensource org licen[sc]es isc", 0.95),
    ("hpnd", r"permission to use copy modify and distribute this software and its documentation for any purpose (?:and without fee )?is hereby granted", 0.9),
    ("ntp", r"permission to use copy modify and distribute this software and its documentation for any purpose with or without fee is hereby granted", 0.9),
    ("ncsa", r"to deal with the software without restriction including without limitation", 0.95),
    # BSD
    ("bsd", r"redistribution and use in source and binary forms with or without modification are permitted", 0.95),
    ("bsd", r"redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", 0.9),
    ("bsd", r"redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer", 0.9),
    ("bsd-3-clause", r"neither the names? of (?:the )?[a-z0-9 ]{1,60} nor the names of (?:its|any|their) contributors may be used to endorse or promote products", 1.0),
    ("bsd-3-clause", r"the names? of the authors? may not be used to endorse or promote products derived from this software without specific prior written permission", 0.95),
    ("bsd-4-clause", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment", 1.0),
    ("bsd-3-clause-clear", r"no express or implied licen[sc]es to any party s patent rights are granted by this licen[sc]e", 0.95),
    ("bsd", r"use of this source code is governed by a bsd style licen[sc]e", 0.95),
    ("bsd", r"licen[sc]ed under (?:the )?(?:terms of (?:the )?)?bsd", 0.8),
    ("bsd", r"(?:released|distributed) under (?:the )?(?:terms of (?:the )?)?bsd", 0.8),
    ("bsd-2-clause", r"opensource org licen[sc]es bsd 2 clause", 0.95),
    ("bsd-3-clause", r"opensource org licen[sc]es bsd 3 clause", 0.95),
    ("0bsd", r"opensource org licen[sc]es 0bsd", 0.95),
    # Apache
    ("apache-2.0", r"licen[sc]ed under the apache licen[sc]e version 2 0 the licen[sc]e you may not use this file except in compliance with the licen[sc]e", 1.0),
    ("apache-2.0", r"unless required by applicable law or agreed to in writing software distributed under the licen[sc]e is distributed on an as is basis", 0.95),
    ("apache-2.0", r"terms and conditions for use reproduction and distribution", 0.8),
    ("apache-2.0", r"each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright licen[sc]e", 0.95),
    ("apache-1.1", r"this product includes software developed by the apache software foundation", 0.9),
    ("apache-1.0", r"this product includes software developed by the apache group", 0.95),
    ("apache", r"licen[sc]ed to the apache software foundation asf under one or more contributor licen[sc]e agreements", 0.9),
    ("apache-2.0", r"(?:licen[sc]ed|released|distributed) under (?:the )?(?:terms of (?:the )?)?apache 2(?: 0)?", 0.95),
    ("apache-2.0", r"asl ?2(?: 0)? licen[sc]e", 0.8),
    # GNU
    ("gpl-2.0-or-later", r"under the terms of the gnu general public licen[sc]e as published by the free software foundation either version 2 of the licen[sc]e or at your option any later version", 1.0),
    ("gpl-3.0-or-later", r"under the terms of the gnu general public licen[sc]e as published by the free software foundation either version 3 of the licen[sc]e or at your option any later version", 1.0),
    ("gpl-1.0-or-later", r"under the terms of the gnu general public licen[sc]e as published by the free software foundation either version 1 or at your option any later version", 1.0),
    ("gpl-2.0-only", r"under the terms of (?:the gnu general public licen[sc]e )?version 2 (?:only )?of the gnu general public licen[sc]e", 0.95),
    ("gpl-2.0-only", r"gnu general public licen[sc]e version 2 only", 0.95),
    ("gpl", r"under the terms of the gnu general public licen[sc]e", 0.9),
    ("gpl", r"you should have received a copy of the gnu general public licen[sc]e along with this (?:program|file|software|library)", 0.9),
    ("gpl", r"see the gnu general public licen[sc]e for more details", 0.9),
    ("gpl", r"this program comes with absolutely no warranty", 0.7),
    ("gpl", r"this program is free software you can redistribute it and or modify it", 0.8),
    ("gpl", r"the licen[sc]es for most software are designed to take away your freedom to share and change it", 0.95),
    ("gpl-3.0", r"the gnu general public licen[sc]e is a free copyleft licen[sc]e for software and other kinds of works", 1.0),
    ("lgpl-2.1-or-later", r"under the terms of the gnu lesser general public licen[sc]e as published by the free software foundation either version 2 1 of the licen[sc]e or at your option any later version", 1.0),
    ("lgpl-3.0-or-later", r"under the terms of the gnu lesser general public licen[sc]e as published by the free software foundation either version 3 of the licen[sc]e or at your option any later version", 1.0),
    ("lgpl-2.0-or-later", r"under the terms of the gnu library general public licen[sc]e as published by the free software foundation either version 2 of the licen[sc]e or at your option any later version", 1.0),
    ("lgpl", r"under the terms of the gnu (?:lesser|library) general public licen[sc]e", 0.9),
    ("lgpl", r"you should have received a copy of the gnu (?:lesser|library) general public licen[sc]e along with this (?:program|file|software|library)", 0.9),
    ("lgpl", r"see the gnu (?:lesser|library) general public licen[sc]e for more details", 0.9),
    ("lgpl", r"this library is free software you can redistribute it and or modify it", 0.8),
    ("lgpl-3.0", r"this version of the gnu lesser general public licen[sc]e incorporates the terms and conditions of version 3", 1.0),
    ("agpl-3.0-or-later", r"under the terms of the gnu affero general public licen[sc]e as published by the free software foundation either version 3 of the licen[sc]e or at your option any later version", 1.0),
    ("agpl", r"under the terms of the gnu affero general public licen[sc]e", 0.95),
    ("agpl", r"you should have received a copy of the gnu affero general public licen[sc]e along with this (?:program|file|software|library)", 0.95),
    ("gfdl", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[sc]e", 1.0),
    ("gfdl-1.2", r"gnu free documentation licen[sc]e version 1 2 or any later version published by the free software foundation", 0.95),
    ("gfdl-1.3", r"gnu free documentation licen[sc]e version 1 3 or any later version published by the free software foundation", 0.95),
    ("gpl-with-gcc-exception", r"gcc runtime library exception", 0.95),
    ("gpl-with-openssl-exception", r"permission to link (?:the code of (?:portions of )?this program )?with the openssl library", 0.95),
    ("gpl-with-autoconf-exception", r"as a special exception to the gnu general public licen[sc]e if you distribute this file as part of a program that contains a configuration script generated by autoconf", 1.0),
    ("gpl-with-bison-exception", r"as a special exception you may create a larger work that contains part or all of the bison parser skeleton", 1.0),
    ("gpl-with-font-exception", r"as a special exception if you create a document which uses this font", 1.0),
    ("gpl-with-linux-syscall-note", r"this copyright does not cover user programs that use kernel services by normal system calls", 1.0),
    ("gnu-all-permissive", r"copying and distribution of this file with or without modification are permitted in any medium without royalty", 1.0),
    ("fsf-unlimited", r"this file is free software the free software foundation gives unlimited permission to copy and or distribute it", 1.0),
    # Mozilla, Eclipse, Sun, Microsoft and other copyleft by file
    ("mpl-2.0", r"this source code form is subject to the terms of the mozilla public licen[sc]e v ?2 0", 1.0),
    ("mpl-2.0", r"if a copy of the mpl was not distributed with this file you can obtain one at", 1.0),
    ("mpl-1.1", r"the contents of this file are subject to the mozilla public licen[sc]e version 1 1", 1.0),
    ("mpl-1.0", r"the contents of this file are subject to the mozilla public licen[sc]e version 1 0", 1.0),
    ("mpl-1.1", r"alternatively the contents of this file may be used under the terms of either the gnu general public licen[sc]e version 2 or later the gpl", 0.9),
    ("npl-1.1", r"the contents of this file are subject to the netscape public licen[sc]e version 1 1", 1.0),
    ("npl-1.0", r"the contents of this file are subject to the netscape public licen[sc]e version 1 0", 1.0),
    ("epl-1.0", r"made available under the terms of the eclipse public licen[sc]e v ?1 0", 1.0),
    ("epl-2.0", r"made available under the terms of the eclipse public licen[sc]e v ?2 0", 1.0),
    ("epl-2.0", r"this program and the accompanying materials are made available under the terms of the eclipse public licen[sc]e 2 0", 1.0),
    ("epl", r"this program and the accompanying materials are (?:made available|licen[sc]ed) under the terms of the eclipse public licen[sc]e", 0.9),
    ("edl-1.0", r"eclipse distribution licen[sc]e v(?:ersion)? ?1 0", 1.0),
    ("cpl-1.0", r"made available under the terms of the common public licen[sc]e v ?1 0", 1.0),
    ("ipl-1.0", r"ibm public licen[sc]e version 1 0", 1.0),
    ("cddl", r"the contents of this file are subject to the terms of the common development and distribution licen[sc]e", 1.0),
    ("cddl", r"you can obtain a copy of the licen[sc]e at usr src opensolaris licen[sc]e", 0.95),
    ("cpal-1.0", r"the contents of this file are subject to the common public attribution licen[sc]e version 1 0", 1.0),
    ("apsl-2.0", r"this file contains original code and or modifications of original code as defined in and that are subject to the apple public source licen[sc]e version 2 0", 1.0),
    ("sgi-b-2.0", r"sgi free software licen[sc]e b version 2 0", 1.0),
    ("spl-1.0", r"sun public licen[sc]e version 1 0", 1.0),
    ("sissl", r"sun industry standards source licen[sc]e", 0.95),
    ("ms-pl", r"this licen[sc]e governs use of the accompanying software if you use the software you accept this licen[sc]e", 0.95),
    ("ms-rl", r"reciprocal grants for any file you distribute that contains code from the software", 1.0),
    ("qpl-1.0", r"the q public licen[sc]e version 1 0", 1.0),
    ("osl-3.0", r"licen[sc]ed under the open software licen[sc]e version 3 0", 1.0),
    ("afl-3.0", r"licen[sc]ed under the academic free licen[sc]e version 3 0", 1.0),
    ("eupl-1.2", r"licen[sc]ed under the eupl version 1 2", 1.0),
    ("eupl-1.1", r"licen[sc]ed under the eupl version 1 1", 1.0),
    ("eupl", r"licen[sc]ed under (?:the )?eupl", 0.9),
    ("cecill", r"governed by the cecill(?: [bc])? licen[sc]e under french law", 1.0),
    ("mulanpsl-2.0", r"licen[sc]ed under (?:the )?mulan psl v2", 1.0),
    ("mulanpsl-1.0", r"licen[sc]ed under (?:the )?mulan psl v1", 1.0),
    ("busl-1.1", r"the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licen[sc]ed work", 1.0),
    ("elastic-2.0", r"you may not provide the software to third parties as a hosted or managed service", 1.0),
    ("commons-clause", r"the grant of rights under the licen[sc]e will not include and the licen[sc]e does not grant to you the right to sell the software", 1.0),
    ("polyform-noncommercial", r"any noncommercial purpose is a permitted purpose", 0.95),
    # Permissive with texts of their own
    ("zlib", r"altered source versions must be plainly marked as such and must not be misrepresented as being the original software", 1.0),
    ("zlib", r"this software is provided as is without any express or implied warranty in no event will the authors be held liable", 0.95),
    ("zlib", r"this notice may not be removed or altered from any source distribution", 0.9),
    ("libpng", r"this code is released under the libpng licen[sc]e", 0.95),
    ("bsl-1.0", r"distributed under the boost software licen[sc]e version 1 0", 1.0),
    ("bsl-1.0", r"boost org licen[sc]e 1 0 txt", 0.95),
    ("unlicense", r"this is free and unencumbered software released into the public domain", 1.0),
    ("unlicense", r"anyone is free to copy modify publish use compile sell or distribute this software", 0.95),
    ("unlicense", r"in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest", 0.95),
    ("wtfpl", r"do what the (?:fuck|hell) you want to public licen[sc]e", 1.0),
    ("wtfpl", r"everyone is permitted to copy and distribute verbatim or modified copies of this licen[sc]e document and changing it is allowed", 0.9),
    ("beerware", r"as long as you retain this notice you can do whatever you want with this stuff", 1.0),
    ("cc0-1.0", r"to the extent possible under law the author s? ?(?:has|have) (?:waived|dedicated) all copyright and related (?:or|and) neighboring rights", 1.0),
    ("cc0-1.0", r"dedicate all copyright and related and neighboring rights to this software to the public domain worldwide", 1.0),
    ("cc0-1.0", r"no copyright the person who associated a work with this deed has dedicated the work to the public domain", 1.0),
    ("blessing", r"the author disclaims copyright to this source code in place of a legal notice here is a blessing", 1.0),
    ("json", r"the software shall be used for good not evil", 1.0),
    ("openssl", r"this product includes software developed by the openssl project for use in the openssl toolkit", 1.0),
    ("ssleay", r"this product includes cryptographic software written by eric young", 1.0),
    ("php-3.01", r"this source file is subject to version 3 01 of the php licen[sc]e", 1.0),
    ("php-3.0", r"this source file is subject to version 3 0 of the php licen[sc]e", 1.0),
    ("php", r"this product includes php software freely available from", 0.95),
    ("python-2.0", r"psf hereby grants licensee a nonexclusive royalty free world wide licen[sc]e", 1.0),
    ("python-2.0", r"python software foundation licen[sc]e agreement", 0.95),
    ("cnri-python", r"cnri hereby grants licensee a nonexclusive royalty free world wide licen[sc]e", 1.0),
    ("zpl-2.1", r"this software is subject to the provisions of the zope public licen[sc]e version 2 1", 1.0),
    ("zpl-2.0", r"this software is subject to the provisions of the zope public licen[sc]e version 2 0", 1.0),
    ("artistic-2.0", r"everyone is permitted to copy and distribute verbatim copies of this licen[sc]e document but changing it is not allowed preamble this licen[sc]e establishes the terms under which a given free software package", 1.0),
    ("perl", r"(?:under|on) the same terms as perl(?: itself)?", 0.9),
    ("ruby", r"(?:under|on) the same terms as ruby", 0.9),
    ("lppl", r"(?:under|of) the conditions of the latex project public licen[sc]e", 0.95),
    ("tcl", r"the authors hereby grant permission to use copy modify distribute and licen[sc]e this software and its documentation for any purpose", 1.0),
    ("curl", r"curl and libcurl are licen[sc]ed under", 0.9),
    ("icu", r"icu licen[sc]e icu 1 8 1 and later", 1.0),
    ("unicode", r"unicode inc licen[sc]e agreement data files and software", 1.0),
    ("unicode", r"permission is hereby granted free of charge to any person obtaining a copy of the unicode data files", 1.0),
    ("w3c", r"w3c (?:r )?software (?:and document )?notice and licen[sc]e", 1.0),
    ("w3c", r"by obtaining using and or copying this work you the licensee agree that you have read understood and will comply", 0.95),
    ("ijg", r"this software is based in part on the work of the independent jpeg group", 1.0),
    ("ftl", r"portions of this software are copyright (?:c )?[0-9 ]{0,12}the freetype project", 1.0),
    ("info-zip", r"for the purposes of this copyright and licen[sc]e info zip is defined as", 1.0),
    ("bzip2", r"the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product", 0.9),
    ("intel-acpi", r"intel grants free of charge to any person licensee obtaining a copy of the source code appearing in this file", 1.0),
    ("postgresql", r"permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted", 1.0),
    ("ofl-1.1", r"this font software is licen[sc]ed under the sil open font licen[sc]e version 1 1", 1.0),
    ("ofl", r"the goals of the open font licen[sc]e ofl are to stimulate worldwide development of collaborative font projects", 1.0),
    ("ofl", r"with reserved font names?", 0.8),
    ("bitstream-vera", r"permission is hereby granted free of charge to any person obtaining a copy of the fonts accompanying this licen[sc]e", 1.0),
    ("ubuntu-font", r"ubuntu font licen[sc]e", 0.95),
    ("odbl-1.0", r"made available under the open database licen[sc]e", 0.95),
    ("odc-by-1.0", r"open data commons attribution licen[sc]e", 0.95),
    ("pddl-1.0", r"open data commons public domain dedication and licen[sc]e", 1.0),
    ("cdla-permissive", r"community data licen[sc]e agreement permissive", 1.0),
    ("cdla-sharing", r"community data licen[sc]e agreement sharing", 1.0),
    ("ogl-uk", r"open government licen[sc]e", 0.9),
    ("etalab", r"licence ouverte|open licence etalab", 0.9),
    ("openrail", r"(?:creativeml )?open ?rail ?m? licen[sc]e", 0.9),
    ("openrail", r"responsible ai licen[sc]e", 0.9),
    ("llama", r"llama [0-9](?: [0-9])? community licen[sc]e", 0.95),
    # Creative Commons in words
    ("cc-by-4.0", r"(?:this work is )?licen[sc]ed under a creative commons attribution 4 0 international licen[sc]e", 1.0),
    ("cc-by-sa-4.0", r"(?:this work is )?licen[sc]ed under a creative commons attribution share ?alike 4 0 international licen[sc]e", 1.0),
    ("cc-by-nc-4.0", r"(?:this work is )?licen[sc]ed under a creative commons attribution non ?commercial 4 0 international licen[sc]e", 1.0),
    ("cc-by-nd-4.0", r"(?:this work is )?licen[sc]ed under a creative commons attribution no ?derivatives 4 0 international licen[sc]e", 1.0),
    ("cc-by-nc-sa-4.0", r"(?:this work is )?licen[sc]ed under a creative commons attribution non ?commercial share ?alike 4 0 international licen[sc]e", 1.0),
    ("cc-by-nc-nd-4.0", r"(?:this work is )?licen[sc]ed under a creative commons attribution non ?commercial no ?derivatives 4 0 international licen[sc]e", 1.0),
    ("cc-by-sa-3.0", r"text is available under the creative commons attribution share ?alike licen[sc]e", 0.95),
    ("cc-by-3.0", r"content (?:on this site )?is licen[sc]ed under (?:a )?creative commons attribution 3 0", 0.95),
    ("creative-commons", r"some rights reserved", 0.5),
    ("cc-by-nc", r"free to share (?:copy )?(?:and )?adapt (?:this work )?for non ?commercial purposes", 0.6),
    # Content and web notices
    ("terms-of-use", r"by (?:using|accessing) this (?:site|website|service) you agree to (?:our|the|these) terms", 0.7),
    ("terms-of-use", r"subject to (?:our|the) terms of (?:use|service)", 0.5),
    ("no-reproduction", r"no part of this (?:publication|book|work|document) may be reproduced", 0.95),
    ("no-reproduction", r"may not be published broadcast rewritten or redistributed|may not be reproduced distributed transmitted cached or otherwise used", 0.95),
    ("no-reproduction", r"may not be reproduced (?:or distributed )?without (?:the )?(?:prior )?(?:express )?(?:written )?(?:permission|consent)", 0.9),
    ("no-reproduction", r"reproduction (?:in whole or in part )?without permission is prohibited", 0.9),
    ("no-reproduction", r"unauthori[sz]ed (?:copying|reproduction|use|distribution|duplication) (?:and or duplication )?(?:of this [a-z]{1,20} )?(?:without [a-z ]{1,60} )?is (?:strictly )?prohibited", 0.9),
    ("no-reproduction", r"reprinted with permission", 0.6),
    ("no-reproduction", r"used (?:by|with) permission", 0.4),
    ("no-text-mining", r"text and data mining", 0.7),
    ("no-ai-training", r"may not be used (?:to|for) train(?:ing)? (?:of )?(?:any )?(?:ai|artificial intelligence|machine learning|large language)", 1.0),
    ("no-ai-training", r"train(?:ing)? (?:of )?(?:ai|artificial intelligence|machine learning) (?:models? )?is (?:not permitted|prohibited)", 1.0),
    ("fair-use", r"constitutes a fair use of any such copyrighted material", 0.8),
    ("public-domain", r"(?:this|the) (?:work|image|file|document|ebook|book|text) is in the public domain", 0.95),
    ("public-domain", r"(?:has been|is|are|was) (?:hereby )?(?:released|placed|dedicated) (?:into|in|to) the public domain", 0.95),
    ("public-domain", r"public domain in the united states", 0.9),
    ("public-domain", r"is not subject to copyright protection(?: and is in the public domain)?", 0.8),
    ("gutenberg", r"project gutenberg (?:tm )?licen[sc]e", 0.95),
    # Closed software
    ("proprietary", r"this software is the confidential and proprietary information of", 1.0),
    ("proprietary", r"proprietary and confidential", 0.9),
    ("proprietary", r"(?:strictly )?confidential do not distribute", 0.8),
    ("proprietary", r"confidential (?:and proprietary )?information (?:of|belonging to)|proprietary (?:and confidential )?information (?:of|belonging to)", 0.9),
    ("eula", r"end user licen[sc]e agreement", 0.8),
    ("eula", r"you may not reverse engineer decompile or disassemble", 0.8),
    ("eula", r"this licen[sc]e agreement is a legal agreement between you", 0.9),
    ("restricted-rights", r"u ?s government (?:users )?restricted rights", 0.8),
    ("non-commercial", r"not for commercial use|not for resale", 0.8),
    ("non-commercial", r"(?:free )?for (?:personal and )?non ?commercial (?:use|purposes)(?: only)?", 0.7),
    ("non-commercial", r"commercial use (?:of this [a-z]{1,20} )?is (?:not permitted|not allowed|prohibited|forbidden)", 0.9),
    ("shareware", r"this is shareware|shareware version", 0.7),
    ("freeware", r"this (?:program|software) is freeware", 0.7),
    ("patent-grant", r"additional grant of patent rights", 0.8),
    ("patent-grant", r"grants? (?:to )?you a (?:perpetual )?(?:worldwide )?(?:non exclusive )?(?:no charge )?(?:royalty free )?(?:irrevocable )?patent licen[sc]e", 0.8),
    ("cla", r"contributor licen[sc]e agreement", 0.6),
    # Disclaimers
    ("warranty", r"the software is provided as is without warrant(?:y|ies) of any kind", 0.8),
    ("warranty", r"this software is provided (?:by the (?:authors?|regents|copyright holders?)(?: and contributors?)? )?as is and any express or implied warrant(?:y|ies)", 0.8),
    ("warranty", r"without even the implied warranty of merchantability or fitness for a particular purpose", 0.8),
    ("warranty", r"in no event shall the (?:authors?|regents|copyright (?:holders?|owners?))(?: (?:or|and) (?:copyright holders?|contributors?))? be liable", 0.7),
    ("warranty", r"without warrant(?:y|ies) of any kind", 0.6),
    ("warranty", r"warranties of merchantability", 0.5),
    ("warranty", r"(?:disclaims?|disclaimer of) (?:all )?(?:express or implied )?warrant(?:y|ies)", 0.5),
    ("warranty", r"provided (?:by the (?:authors?|copyright holders?)(?: and contributors)? )?as is", 0.5),
]

#: Names with versions: (label stem, versions, patterns). {} stands for the version.
FAMILIES = [
    ("gpl", ("1.0", "2.0", "3.0"), [r"gnu general public licen[sc]e(?: as published by the free software foundation)?(?: either)? (?:version |v ?)?{}", r"gnu gpl (?:version |v ?)?{}", r"gpl ?(?:version |v)? ?{}(?: only| or later)?", r"gplv{}", r"gnu org licen[sc]es (?:old licenses )?gpl {}", r"opensource org licen[sc]es gpl {}"]),
    ("lgpl", ("2.0", "2.1", "3.0"), [r"gnu (?:lesser|library) general public licen[sc]e (?:version |v ?)?{}", r"gnu lgpl (?:version |v ?)?{}", r"lgpl ?(?:version |v)? ?{}(?: only| or later)?", r"lgplv{}", r"gnu org licen[sc]es (?:old licenses )?lgpl {}", r"opensource org licen[sc]es lgpl {}"]),
    ("agpl", ("1.0", "3.0"), [r"agpl ?(?:version |v)? ?{}(?: only| or later)?", r"agplv{}", r"(?:gnu )?affero general public licen[sc]e (?:version |v ?)?{}", r"gnu org licen[sc]es agpl {}"]),
    ("gfdl", ("1.1", "1.2", "1.3"), [r"gnu free documentation licen[sc]e (?:version |v ?)?{}", r"gnu org licen[sc]es fdl {}"]),
    ("apache", ("1.0", "1.1", "2.0"), [r"apache (?:software )?licen[sc]e (?:version |v ?)?{}", r"apache ?{} licen[sc]e", r"apache org licen[sc]es licen[sc]e {}"]),
    ("mpl", ("1.0", "1.1", "2.0"), [r"mozilla public licen[sc]e (?:version |v ?)?{}", r"mozilla org (?:en us )?mpl {}", r"mpl ?(?:version |v)? ?{}"]),
    ("epl", ("1.0", "2.0"), [r"eclipse public licen[sc]e (?:version |v ?)?{}", r"eclipse org legal epl v?{}"]),
    ("cpl", ("0.5", "1.0"), [r"common public licen[sc]e (?:version |v ?)?{}"]),
    ("cddl", ("1.0", "1.1"), [r"common development and distribution licen[sc]e (?:version |v ?)?{}", r"cddl ?(?:version |v)? ?{}"]),
    ("artistic", ("1.0", "2.0"), [r"artistic licen[sc]e (?:version |v ?)?{}"]),
    ("osl", ("1.0", "2.0", "2.1", "3.0"), [r"open software licen[sc]e (?:version |v ?)?{}"]),
    ("afl", ("1.1", "1.2", "2.0", "2.1", "3.0"), [r"academic free licen[sc]e (?:version |v ?)?{}"]),
    ("eupl", ("1.0", "1.1", "1.2"), [r"european union public licen[sc]e (?:version |v ?)?{}"]),
    ("cecill", ("1.0", "2.0", "2.1"), [r"cecill(?: [bc])?(?: free software)? ?(?:licen[sc]e )?(?:agreement )?(?:version |v ?)?{}"]),
    ("ofl", ("1.0", "1.1"), [r"(?:sil )?open font licen[sc]e (?:version |v ?)?{}", r"scripts sil org ofl licen[sc]e {}"]),
    ("bsl", ("1.0",), [r"boost software licen[sc]e (?:version |v ?)?{}"]),
    ("busl", ("1.0", "1.1"), [r"business source licen[sc]e (?:version |v ?)?{}"]),
    ("python", ("2.0", "2.0.1"), [r"python (?:software foundation )?licen[sc]e (?:version |v ?)?{}"]),
    ("php", ("3.0", "3.01"), [r"php licen[sc]e (?:version |v ?)?{}"]),
    ("zpl", ("1.1", "2.0", "2.1"), [r"zope public licen[sc]e (?:version |v ?)?{}"]),
    ("lppl", ("1.0", "1.1", "1.2", "1.3"), [r"latex project public licen[sc]e (?:version |v ?)?{}"]),
    ("odbl", ("1.0",), [r"open database licen[sc]e (?:version |v ?)?{}", r"opendatacommons org licen[sc]es odbl {}"]),
    ("sspl", ("1.0",), [r"server side public licen[sc]e (?:version |v ?)?{}"]),
    ("apsl", ("1.0", "1.1", "1.2", "2.0"), [r"apple public source licen[sc]e (?:version |v ?)?{}"]),
    ("npl", ("1.0", "1.1"), [r"netscape public licen[sc]e (?:version |v ?)?{}"]),
    ("upl", ("1.0",), [r"universal permissive licen[sc]e (?:version |v ?)?{}"]),
    ("rpl", ("1.1", "1.5"), [r"reciprocal public licen[sc]e (?:version |v ?)?{}"]),
]

#: Creative Commons: (label stem, words of the abbreviation, words of the name).
CC_KINDS = [
    ("cc-by-nc-sa", "by nc sa", r"attribution non ?commercial share ?alike"),
    ("cc-by-nc-nd", "by nc nd", r"attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?"),
    ("cc-by-nc", "by nc", r"attribution non ?commercial"),
    ("cc-by-nd", "by nd", r"attribution no ?deriv(?:ative)?s?(?: works)?"),
    ("cc-by-sa", "by sa", r"attribution share ?alike"),
    ("cc-by", "by", r"attribution"),
]
CC_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")

#: Bare names and vague hints.
NAMES = [
    ("mit", r"(?:the )?mit(?: x11| expat)? licen[sc]e", 0.95),
    ("bsd-2-clause", r"(?:2 clause|two clause|simplified) bsd(?: licen[sc]e)?|bsd 2 clause(?: licen[sc]e)?|freebsd licen[sc]e", 0.95),
    ("bsd-3-clause", r"(?:3 clause|three clause|new|modified|revised) bsd(?: licen[sc]e)?|bsd 3 clause(?: licen[sc]e)?", 0.95),
    ("bsd-4-clause", r"(?:4 clause|original|old) bsd(?: licen[sc]e)?|bsd 4 clause(?: licen[sc]e)?", 0.95),
    ("0bsd", r"(?:zero clause )?0bsd(?: licen[sc]e)?|zero clause bsd(?: licen[sc]e)?|bsd zero clause(?: licen[sc]e)?", 0.95),
    ("bsd", r"bsd(?: style)? licen[sc]e", 0.7),
    ("isc", r"isc licen[sc]e", 0.95),
    ("zlib", r"zlib(?: libpng)? licen[sc]e", 0.95),
    ("unlicense", r"(?:the )?unlicense(?: org)?", 0.9),
    ("wtfpl", r"wtfpl", 0.95),
    ("cc0-1.0", r"cc0(?: 1 0)?(?: universal)?", 0.95),
    ("cc0-1.0", r"creativecommons org publicdomain zero(?: 1 0)?", 0.9),
    ("public-domain", r"(?:released |placed |dedicated )?(?:into|in|to) the public domain", 0.8),
    ("beerware", r"beerware(?: licen[sc]e)?|beer ware licen[sc]e", 0.9),
    ("ms-pl", r"microsoft public licen[sc]e", 0.95),
    ("ms-rl", r"microsoft reciprocal licen[sc]e", 0.95),
    ("openssl", r"openssl licen[sc]e", 0.95),
    ("vim", r"vim licen[sc]e", 0.9),
    ("ncsa", r"(?:university of illinois )?ncsa(?: open source)? licen[sc]e", 0.95),
    ("postgresql", r"postgresql licen[sc]e", 0.95),
    ("elastic", r"elastic licen[sc]e(?: 2 0)?", 0.9),
    ("mulanpsl", r"mulan (?:permissive software licen[sc]e|psl)", 0.9),
    ("artistic", r"(?:perl )?artistic licen[sc]e", 0.7),
    ("gpl", r"gnu general public licen[sc]e", 0.8),
    ("lgpl", r"gnu (?:lesser|library) general public licen[sc]e", 0.8),
    ("agpl", r"(?:gnu )?affero general public licen[sc]e", 0.8),
    ("gfdl", r"gnu free documentation licen[sc]e", 0.8),
    ("gpl", r"gnu gpl", 0.7),
    ("lgpl", r"gnu lgpl", 0.7),
    ("apache", r"apache (?:software )?licen[sc]e", 0.7),
    ("mpl", r"mozilla public licen[sc]e", 0.7),
    ("epl", r"eclipse public licen[sc]e", 0.7),
    ("cddl", r"common development and distribution licen[sc]e", 0.7),
    ("eupl", r"european union public licen[sc]e", 0.7),
    ("ofl", r"open font licen[sc]e", 0.7),
    ("odbl", r"open database licen[sc]e", 0.7),
    ("creative-commons", r"creative commons(?: licen[sc]e)?", 0.5),
    ("commercial", r"commercial licen[sc]e", 0.6),
    ("dual", r"dual licen[sc]ed", 0.5),
    ("open-source", r"open source licen[sc]e", 0.4),
    ("copyright", r"copyright (?:c )?(?:19|20)[0-9][0-9](?: (?:19|20)[0-9][0-9])?", 0.5),
    ("copyright", r"copyright (?:notice|holders?|owners?)", 0.3),
    ("copyleft", r"copyleft", 0.4),
    ("licensed", r"(?:is |are )?licen[sc]ed under(?: the)?(?: terms of)?(?: the| this| our| an?)?(?: following)? (?:licen[sc]e|agreement|terms|conditions)", 0.3),
    ("licensed", r"see (?:the )?licen[sc]e (?:file )?(?:for (?:more )?(?:details|information)|in the)", 0.3),
]

#: Rare ones first: of these a rule takes the first that its pattern always holds.
KEYWORDS = (
    "spdx", "unlicense", "creativecommons", "creative commons", "wtfpl", "cddl", "cecill", "eupl", "mulan", "affero", "agpl", "lgpl", "mozilla", "netscape", "eclipse", "zope", "latex", "apache", "boost", "openssl", "zlib", "libpng", "php",
    "python", "perl", "ruby", "cc0", "public domain", "mpl", "gpl", "gnu", "bsd", "isc", "mit", "ncsa", "postgresql", "vim", "w3c", "unicode", "jpeg", "freetype", "gutenberg", "ebook", "opendatacommons", "open data", 
    "open font", "font", "microsoft", "retain", "shareware", "freeware", "beer", "proprietary", "confidential", "commercial", "merchantability", "warrant", "redistribut", "restrict", "reverse engineer", "reproduced", "reproduction", "unauthori",
    "copyleft", "copyright", "public licen", "public", "mining", "train", "terms", "patent", "signed off", "permission", "trade secret", "agreement", "advertis", "endorse", "government", "evaluation", 
    "licen", "provided", "software", "cc", "rights", "source", "origin", "resale", 
    "bison", "liable", "clause",
)

#: Single words of which every match of a rule or base phrase holds one, in any case of its letters ("cc" rules apart).
GATE_WORDS = (
    "licen", "gpl", "mpl", "bsd", "cddl", "cecill", "creative", "cc0", "wtfpl", "permi", "redistribut", "domain", "warrant", "copy", "reserved", "apache", "eclipse", "proprietary", "confidential", "commercial", "reproduc", "reverse",
    "liable", "terms", "provided", "software", "patent", "contribut", "exception", "altered", "beerware", "retain", "mining", "train", "resale", "shareware", "freeware", "mulan", "unauthori", "restricted",
)


def spaced(text: str) -> str:
    """'2.0' as it reads in normalised text; a trailing zero may be missing."""
    words = text.replace(".", " ").split()
    return " ".join(words[:-1]) + "(?: 0)?" if len(words) > 1 and words[-1] == "0" else " ".join(words)


def alternatives(pattern: str) -> list[str]:
    """A pattern's alternatives at its top level; each becomes a rule of its own."""
    level, out = 0, [""]
    for c in pattern:
        level += (c == "(") - (c == ")")
        if c == "|" and level == 0:
            out.append("")
        else:
            out[-1] += c
    return out


def fixed_words(pattern: str) -> list[str]:
    """The literal runs that every match of a pattern without top-level alternatives holds."""
    while "(" in pattern:  # groups may be optional or alternatives: nothing in them is fixed
        pattern = re.sub(r"\([^()]*\)[?*]?", "\n", pattern)
    pattern = re.sub(r"\[[^]]*\](?:\{[^}]*\}|[?*+])?", "\n", pattern)
    return re.sub(r".[?*]", "\n", pattern).split("\n")


def keyword_of(pattern: str) -> str:
    fixed = fixed_words(pattern)
    for k in KEYWORDS:
        if any(k in run for run in fixed):
            return k
    raise ValueError(f"no keyword stands in every match of {pattern}")


def _rules():
    tags, named, labels = [], [], []
    for stem, versions, patterns in FAMILIES:
        for v in versions:
            label = f"{stem}-{v}"
            labels.append(label)
            named += [(label, p.replace("{}", spaced(v)), 0.95) for p in patterns]
    for stem, short, name in CC_KINDS:
        for v in CC_VERSIONS:
            label = f"{stem}-{v}"
            labels.append(label)
            named.append((label, rf"cc {short} {spaced(v)}", 0.95))
            named.append((label, rf"creative commons {name}(?: (?:international|unported|generic))? {spaced(v)}", 0.95))
            named.append((label, rf"creativecommons org licenses {short} {spaced(v)}", 0.9))
        labels.append(stem)
        if stem != "cc-by":
            named.append((stem, rf"cc {short}", 0.8))
        named.append((stem, rf"creative commons {name}", 0.8))
    for label in dict.fromkeys(labels + [x[0] for x in SENTENCES + NAMES if x[2] >= 0.9]):
        words = spaced(label.replace("-", " "))
        tags.append((label, rf"spdx licen[sc]e identifier {words}(?: only| or later)?", 1.0))
    return [(label, keyword_of(p), p, relevance) for label, whole, relevance in tags + SENTENCES + named + NAMES for p in alternatives(whole)]


RULES = _rules()

#: The phrases that every scan reports: (words, label). Fixed values.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
