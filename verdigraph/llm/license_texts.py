"""Signatures of license texts: sentences of grants, conditions, disclaimers and notices, each with a word that any match has."""

from __future__ import annotations

#: Label, keyword, regex over lower-cased text, where a space stands for any run of white space and comment marks. In order of priority.
SIGNATURES = [
    ("bsl-1.0", "organization", r"permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation"),
    ("bsl-1.0", "boost", r"distributed under the boost software license,? version 1\.0"),
    ("json", "evil", r"the software shall be used for good, not evil"),
    ("mit", "obtaining", r"permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "restriction", r"to deal in the software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute"),
    ("mit", "portions", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", "merchantability", r"the software is provided \W?as is\W?, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability"),
    ("mit", "liable", r"in no event shall the authors or copyright holders be liable for any claim, damages or other liability"),
    ("x11", "contained", r"except as contained in this notice, the names? of .{1,80} shall not be used in advertising or otherwise to promote the sale"),
    ("isc", "distribute", r"permission to use, copy, modify,? and(?:/or)? distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("0bsd", "distribute", r"permission to use, copy, modify,? and(?:/or)? distribute this software for any purpose with or without fee is hereby granted\."),
    ("curl", "distribute", r"permission to use, copy, modify,? and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies\. the software is provided"),
    ("isc", "disclaims", r"the software is provided \W?as is\W? and .{1,60} disclaims all warranties with regard to this software"),
    ("postgresql", "agreement", r"permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted"),
    ("hpnd", "documentation", r"permission to use, copy, modify,? and distribute this software and its documentation for any purpose (?:and|with or) without fee is hereby granted"),
    ("w3c", "royalty", r"permission to copy, modify, and distribute this (?:software|work) and its documentation, with or without modification, for any purpose and without fee or royalty is hereby granted"),
    ("w3c", "w3c", r"w3c software (?:and document )?(?:notice and )?license"),
    ("ntp", "delaware", r"the university of delaware makes no representations about the suitability this software for any purpose"),
    ("ntp", "ntp", r"\bntp license\b"),
    ("bsd-4-clause", "advertising", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("bsd-3-clause", "endorse", r"neither the names? of .{1,120} nor the names of (?:its|his|their|any|the) contributors may be used to endorse or promote products derived from this software"),
    ("bsd-3-clause", "endorse", r"the name of the author may not be used to endorse or promote products derived from this software"),
    ("bsd-2-clause", "conclusions", r"the views and conclusions contained in the software and documentation are those of the authors"),
    ("bsd", "redistributions", r"redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("bsd", "redistributions", r"redistributions in binary form must reproduce the above copyright notice"),
    ("bsd", "redistribution", r"redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("bsd", "disclaimed", r"this software is provided by .{1,80} \W?as is\W? and any express or implied warranties, including, but not limited to, .{1,120} are disclaimed"),
    ("sleepycat", "accompanied", r"redistributions in any form must be accompanied by information on how to obtain complete source code"),
    ("apache-2.0", "january", r"apache license,? version 2\.0, january 2004"),
    ("apache-2.0", "apache", r"licensed under the apache license, version 2\.0"),
    ("apache-2.0", "compliance", r"you may not use this (?:file|software|work) except in compliance with the license"),
    ("apache-2.0", "applicable", r"unless required by applicable law or agreed to in writing, software distributed under the license is distributed on an \W?as is\W? basis"),
    ("apache-2.0", "governing", r"see the license for the specific language governing permissions and limitations under the license"),
    ("apache-2.0", "irrevocable", r"each contributor hereby grants to you a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable (?:copyright|\(except as stated in this section\) patent) license"),
    ("apache-2.0", "appendix", r"appendix: how to apply the apache license to your work"),
    ("apache-2.0", "contributor", r"licensed to the apache software foundation \(asf\) under one or more contributor license agreements"),
    ("apache-1.1", "acknowledg", r"the end-user documentation included with the redistribution, if any, must include the following acknowledge?ment"),
    ("apache-1.1", "apache", r"products derived from this software may not be called \W?apache\W?"),
    ("apache-1.0", "apache", r"this software is provided by the apache group"),
    ("llvm-exception", "llvm", r"apache license v2\.0 with llvm exceptions|llvm exceptions to the apache 2\.0 license"),
    ("gpl-2.0", "june", r"gnu general public license,? version 2, june 1991"),
    ("gpl-3.0", "june", r"gnu general public license,? version 3, 29 june 2007"),
    ("gpl-2.0", "either", r"gnu general public license as published by the free software foundation[;:,] either version 2"),
    ("gpl-3.0", "either", r"gnu general public license as published by the free software foundation[;:,] either version 3"),
    ("gpl-2.0", "version", r"gnu general public license,? version 2,? as published by the free software foundation"),
    ("gpl-3.0", "version", r"gnu general public license,? version 3,? as published by the free software foundation"),
    ("gpl", "redistribute", r"this (?:program|file|software|script|package) is free software[;:,] you can redistribute it and/or modify it under the terms of the gnu general public license"),
    ("gpl", "received", r"you should have received a copy of the gnu general public license"),
    ("gpl", "designed", r"the licenses? for most software(?: and other practical works)? are designed to take away your freedom to share and change"),
    ("gpl", "general", r"the gnu general public license is (?:intended to guarantee your freedom|a free, copyleft license for software)"),
    ("gpl-2.0", "sublicense", r"you may not copy, modify, sublicense, or distribute the program except as expressly provided under this license"),
    ("gpl-2.0", "activities", r"activities other than copying, distribution and modification are not covered by this license"),
    ("gpl-3.0", "propagation", r"to \W?convey\W? a work means any kind of propagation that enables other parties to make or receive copies"),
    ("gpl-3.0", "circumvention", r"protecting users\W? legal rights from anti-circumvention law"),
    ("gpl-3.0", "patent", r"you may not initiate litigation \(including a cross-claim or counterclaim in a lawsuit\) alleging that any patent claim is infringed"),
    ("classpath-exception", "exception", r"as a special exception, the copyright holders of this (?:library|program) give you permission to link this (?:library|program) with independent modules"),
    ("gcc-exception", "runtime", r"gcc runtime library exception"),
    ("font-exception", "font", r"as a special exception, if you create a document which uses this font, and embed this font"),
    ("bison-exception", "bison", r"as a special exception, you may create a larger work that contains part or all of the bison parser skeleton"),
    ("autoconf-exception", "autoconf", r"as a special exception.{1,80} if you distribute this file as part of a program that contains a configuration script generated by autoconf"),
    ("lgpl-2.0", "library", r"gnu library general public license,? version 2, june 1991"),
    ("lgpl-2.1", "lesser", r"gnu lesser general public license,? version 2\.1, february 1999"),
    ("lgpl-3.0", "lesser", r"gnu lesser general public license,? version 3, 29 june 2007"),
    ("lgpl-2.0", "library", r"gnu library general public license as published by the free software foundation[;:,] either version 2"),
    ("lgpl-2.1", "lesser", r"gnu lesser general public license as published by the free software foundation[;:,] either version 2\.1"),
    ("lgpl-3.0", "lesser", r"gnu lesser general public license as published by the free software foundation[;:,] either version 3"),
    ("lgpl", "redistribute", r"this (?:library|program|software|file) is free software[;:,] you can redistribute it and/or modify it under the terms of the gnu (?:lesser|library) general public license"),
    ("lgpl", "received", r"you should have received a copy of the gnu (?:lesser|library) general public license"),
    ("lgpl-2.1", "library", r"a \W?work that uses the library\W?"),
    ("lgpl-3.0", "incorporating", r"object code incorporating material from library header files"),
    ("agpl-3.0", "affero", r"gnu affero general public license,? version 3, 19 november 2007"),
    ("agpl-3.0", "affero", r"gnu affero general public license as published by the free software foundation[;:,] either version 3"),
    ("agpl-3.0", "affero", r"you should have received a copy of the gnu affero general public license"),
    ("agpl-3.0", "remote", r"remote network interaction; use with the gnu general public license"),
    ("fdl", "document", r"permission is granted to copy, distribute and/or modify this document under the terms of the gnu free documentation license"),
    ("fdl", "invariant", r"with no invariant sections, (?:with )?no front-cover texts, and (?:with )?no back-cover texts"),
    ("fdl", "documentation", r"gnu free documentation license,? version 1\.[123]"),
    ("mpl-2.0", "mozilla", r"this source code form is subject to the terms of the mozilla public license, v\. 2\.0"),
    ("mpl-2.0", "mpl", r"if a copy of the mpl was not distributed with this file, you can obtain one at"),
    ("mpl-2.0", "secondary", r"this source code form is \W?incompatible with secondary licenses\W?"),
    ("mpl-1.1", "mozilla", r"the contents of this file are subject to the mozilla public license version 1\.1"),
    ("mpl-1.0", "mozilla", r"the contents of this file are subject to the mozilla public license version 1\.0"),
    ("npl", "netscape", r"netscape public license,? version 1\.[01]"),
    ("epl-1.0", "eclipse", r"made available under the terms of the eclipse public license v ?1\.0"),
    ("epl-2.0", "eclipse", r"made available under the terms of the eclipse public license (?:v\.? ?)?2\.0"),
    ("epl", "eclipse", r"the accompanying program is provided under the terms of this eclipse public license"),
    ("bsd-3-clause", "eclipse", r"eclipse distribution license(?: -)? v ?1\.0"),
    ("cpl-1.0", "common", r"the accompanying program is provided under the terms of this common public license"),
    ("ipl-1.0", "ibm", r"the accompanying program is provided under the terms of this ibm public license"),
    ("cddl-1.0", "development", r"the contents of this file are subject to the terms of the common development and distribution license"),
    ("cddl-1.0", "cddl", r"common development and distribution license \(cddl\) version 1\.[01]"),
    ("cddl-1.0", "opensolaris", r"you can (?:obtain|find) a copy of the license at .{1,40}opensolaris\.license"),
    ("artistic-1.0", "intent", r"the intent of this document is to state the conditions under which a package may be copied"),
    ("artistic-2.0", "establishes", r"this license establishes the terms under which a given free software package may be copied, modified, distributed"),
    ("artistic", "perl", r"redistribute it and/or modify it under the same terms as perl itself"),
    ("zlib", "misrepresented", r"the origin of this software must not be misrepresented[;:,] you must not claim that you wrote the original software"),
    ("zlib", "altered", r"altered source versions must be plainly marked as such, and must not be misrepresented as being the original software"),
    ("zlib", "notice", r"this notice may not be removed or altered from any source distribution"),
    ("zlib", "as-is", r"this software is provided \W?as-is\W?, without any express or implied warranty"),
    ("libpng", "png", r"the png reference library is supplied \W?as is"),
    ("libpng", "libpng", r"this code is released under the libpng license"),
    ("ijg", "jpeg", r"this software is based in part on the work of the independent jpeg group"),
    ("freetype", "freetype", r"portions of this software are copyright .{1,40} the freetype project"),
    ("unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain"),
    ("unlicense", "compile", r"anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"),
    ("unlicense", "jurisdictions", r"in jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest"),
    ("wtfpl", "fuck", r"do what the fuck you want to public license"),
    ("wtfpl", "fuck", r"you just do what the fuck you want to"),
    ("beerware", "retain", r"as long as you retain this notice you can do whatever you want with this stuff"),
    ("cc0-1.0", "waived", r"to the extent possible under law, .{1,120} waived all copyright and related or neighboring rights"),
    ("cc0-1.0", "deed", r"the person who associated a work with this deed has dedicated the work to the public domain"),
    ("cc0-1.0", "affirmer", r"affirmer hereby overtly, fully, permanently, irrevocably and unconditionally waives"),
    ("cc-by-nc-nd", "commons", r"licensed under (?:a|the) creative commons attribution-noncommercial-noderiv(?:ative)?s? (?:works )?[1-4]\.[05]"),
    ("cc-by-nc-sa", "commons", r"licensed under (?:a|the) creative commons attribution-noncommercial-sharealike [1-4]\.[05]"),
    ("cc-by-nc", "commons", r"licensed under (?:a|the) creative commons attribution-noncommercial [1-4]\.[05]"),
    ("cc-by-nd", "commons", r"licensed under (?:a|the) creative commons attribution-noderiv(?:ative)?s? (?:works )?[1-4]\.[05]"),
    ("cc-by-sa", "commons", r"licensed under (?:a|the) creative commons attribution-sharealike [1-4]\.[05]"),
    ("cc-by", "commons", r"licensed under (?:a|the) creative commons attribution [1-4]\.[05]"),
    ("cc", "commons", r"you accept and agree to be bound by the terms and conditions of this creative commons"),
    ("cc", "commons", r"the work \(as defined below\) is provided under the terms of this creative commons public license"),
    ("odbl", "database", r"made available under the open database license"),
    ("odc-by", "attribution", r"made available under the open data commons attribution license"),
    ("pddl", "dedication", r"made available under the (?:open data commons )?public domain dedication and license"),
    ("ofl-1.1", "font", r"this font software is licensed under the sil open font license, version 1\.1"),
    ("ofl-1.1", "stimulate", r"the goals of the open font license \(ofl\) are to stimulate worldwide development"),
    ("ofl-1.1", "font", r"neither the font software nor any of its individual components, in original or modified versions, may be sold by itself"),
    ("psf-2.0", "python", r"psf is making python .{0,40}available to licensee on an \W?as is\W? basis"),
    ("psf-2.0", "python", r"this license agreement is between the python software foundation"),
    ("psf-2.0", "python", r"python software foundation license version 2"),
    ("cnri", "cnri", r"cnri open source (?:gpl-compatible )?license agreement"),
    ("cnri", "initiatives", r"this license agreement is between the corporation for national research initiatives"),
    ("ruby", "redistribute", r"you (?:can|may) redistribute it and/or modify it under either the terms of the (?:2-clause bsdl|gpl)"),
    ("php-3.0", "php", r"this source file is subject to version 3\.0?1? of the php license"),
    ("php-3.0", "php", r"this product includes php software, freely available from"),
    ("php-3.0", "php", r"products derived from this software may not be called \W?php\W?"),
    ("openssl", "openssl", r"this product includes software developed by the openssl project"),
    ("openssl", "cryptographic", r"this product includes cryptographic software written by eric young"),
    ("eupl-1.2", "eupl", r"licensed under the eupl"),
    ("eupl-1.2", "european", r"european union public licen[cs]e,? v(?:ersion|\.)? ?1\.[012]"),
    ("ms-pl", "ms-pl", r"microsoft public license \(ms-pl\)"),
    ("ms-pl", "accompanying", r"this license governs use of the accompanying software\. if you use the software, you accept this license"),
    ("ms-rl", "reciprocal", r"reciprocal grants- for any file you distribute that contains code from the software"),
    ("bsl-1.1", "non-production", r"make non-production use of the licensed work"),
    ("bsl-1.1", "business", r"business source license 1\.1"),
    ("sspl", "october", r"server side public license,? version 1, october 16, 2018"),
    ("sspl", "functionality", r"if you make the functionality of the program or a modified version available to third parties as a service"),
    ("elastic-2.0", "hosted", r"you may not provide the software to third parties as a hosted or managed service"),
    ("elastic-2.0", "elastic", r"elastic license(?:,)? (?:v|version )?2\.0"),
    ("commons-clause", "clause", r"commons clause\W? license condition v1\.0"),
    ("commons-clause", "sell", r"the grant of rights under the license will not include, and the license does not grant to you, the right to sell the software"),
    ("polyform", "polyform", r"polyform (?:noncommercial|small business|strict|shield|perimeter) license"),
    ("vim", "vim", r"there are no restrictions on distributing unmodified copies of vim"),
    ("afl", "academic", r"licensed under the academic free license,? version [123]\.[0-9]"),
    ("osl", "open", r"licensed under the open software license,? version [123]\.[0-9]"),
    ("ecl-2.0", "educational", r"educational community license,? version [12]\.0"),
    ("ncsa", "illinois", r"university of illinois/ncsa open source license"),
    ("qpl", "public", r"the q public license,? version 1\.0"),
    ("tcl", "retained", r"the authors hereby grant permission to use, copy, modify, distribute, and license this software and its documentation for any purpose, provided that existing copyright notices are retained"),
    ("zpl", "zope", r"zope public license \(zpl\)"),
    ("lppl", "latex", r"under the conditions of the latex project public license"),
    ("cecill", "cecill", r"this software is governed by the cecill(?:-[bc])? license"),
    ("mulan", "mulan", r"mulan (?:permissive software license|psl),? (?:v|version )?[12]"),
    ("upl-1.0", "universal", r"universal permissive license(?: \(upl\))?,? (?:v|version )1\.0"),
    ("apsl", "apple", r"apple public source license,? (?:\(apsl\) )?version [12]\.[0-9]"),
    ("sgi-b", "sgi", r"sgi free software license b"),
    ("cpal-1.0", "attribution", r"common public attribution license,? version 1\.0"),
    ("rpl-1.5", "reciprocal", r"reciprocal public license,? (?:version )?1\.[15]"),
    ("fair", "instrument", r"usage of the works is permitted provided that this instrument is retained with the works"),
    ("nasa-1.3", "nasa", r"nasa open source agreement,? version 1\.[0-9]"),
    ("wxwindows", "wxwindows", r"wxwindows library licen[cs]e"),
    ("eiffel", "eiffel", r"eiffel forum license,? version [12]"),
    ("lpl", "lucent", r"lucent public license,? version 1\.0"),
    ("catosl", "associates", r"computer associates trusted open source license"),
    ("rpsl", "realnetworks", r"realnetworks public source license"),
    ("sissl", "industry", r"sun industry standards source license"),
    ("watcom", "watcom", r"sybase open watcom public license"),
    ("oclc", "oclc", r"oclc research public license"),
    ("intel", "intel", r"intel open source license"),
    ("nokia", "nokia", r"nokia open source license"),
    ("entessa", "entessa", r"entessa public license"),
    ("motosoto", "motosoto", r"motosoto open source license"),
    ("vovida", "vovida", r"vovida software license"),
    ("unicode", "unicode", r"unicode(?:,)? inc\. license agreement|unicode data files and software"),
    ("icu", "icu", r"icu license(?: -)? icu 1\.8\.1 and later"),
    ("proprietary", "unauthorized", r"unauthorized copying of this file,? via any medium,? is strictly prohibited"),
    ("proprietary", "confidential", r"this (?:software|file|document) is the confidential and proprietary information of"),
    ("proprietary", "confidential", r"proprietary and confidential"),
    ("public-domain", "domain", r"(?:this (?:software|file|code|work) is|has been|hereby) (?:placed|released|dedicated) (?:in|into|to) the public domain"),
]
