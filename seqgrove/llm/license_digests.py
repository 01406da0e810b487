"""Digests of licence texts in canonical form (license_scan.digest).

Texts of /usr/share/common-licenses of Debian, whole and without title or appendix, with older addresses; MIT, ISC
and BSD texts under their usual titles.
"""

KNOWN_DIGESTS = (
    ("Apache-2.0", "0b8c1a9e0ec99ab3b27e123e667fe4843df4dd7e6c667ccdc634dd6878c5dd6c"),
    ("Apache-2.0", "2e349068b1767ce16c09b3a0a7df25513df42a4881a97a2a0de3ecac55c2ce0a"),
    ("Apache-2.0", "4580e5390400d27df89edd0617548ac0e66eaa029f6e07cf98aac9cd100b3a37"),
    ("Apache-2.0", "67e6c9864a42fc797b7f0244a9e5402dbe5d51fd1cbfdbca4f454f8892ab077d"),
    ("Apache-2.0", "84ed161685d232dab5187a7a7101279668d583e8fcead2d41433e4fd4a1dbe68"),
    ("Apache-2.0", "c7104523952060493e991206663250aa11fa65e90ed0333cf77dbd62951d905d"),
    ("Apache-2.0", "d9fe211089c2132237cee118e2f1a7a3eeee0bc0c68216c559e343102c58cd96"),
    ("Apache-2.0", "e9653af3ea2451e09943fd25004fb790c5c445256e276a8c0172f0a44c13da0b"),
    ("Artistic-1.0-Perl", "08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702"),
    ("Artistic-1.0-Perl", "4eaaa9e33aeef0af0ff83ab5edac0ad421a1da9cc861c564630460107b4b772c"),
    ("BSD-2-Clause", "33903615089fdb3ab02696d1bd92eb9580c2c7a0e0c8714aa95b0dfc1dcdb89c"),
    ("BSD-2-Clause", "447686a56472ea2e9713ca89034ee666e6646bd1a33eba38690cb875708663e2"),
    ("BSD-2-Clause", "b265945940ccdc41492a8c56728fe75bfaf767b67d176e33b2649c7dcf426893"),
    ("BSD-2-Clause", "f9c0de945db946a0b06e8587a80b1b35b3f3e48a0f63cb64860eb4e433d32c7b"),
    ("BSD-3-Clause", "1b9c2fc92ea32d1c705d689163d6e1783efd910af0262514c4185cad11fefe75"),
    ("BSD-3-Clause", "21ce5e311a0ef74591e636cf6d0a236029bcaa0ee86324ac68d5748657aa8651"),
    ("BSD-3-Clause", "69fcedb70fd1930cb5d773bb71eb605a3aec6362c678302194666d60ca468f71"),
    ("BSD-3-Clause", "6dd35bce98db3fa45a370b235b582cdcb2284ef2507066048a386c572223f19a"),
    ("BSD-3-Clause", "73a15ef51d0f74bce7fc4d1287b8d8a639c37581de7f63863957aea115dca7da"),
    ("BSD-3-Clause", "76b173bb2a6492f7941f15493bc75af0a3afc02b9cde5cdc0cad10b180455932"),
    ("BSD-3-Clause", "cc65957a28f15bbcef5b0c23770aae3bd8462cb25904250f77a812ab3b2efe15"),
    ("BSD-3-Clause", "d1ecc0a46c23dad7f9e13b19b877e5be7ec9d2b9bb05a2dfde2e47be83438590"),
    ("BSD-3-Clause", "e612af111b0f62aac3e107973cd804ade8a118ba3c7034d6824ebdce9852ba2e"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("CC0-1.0", "a142ae38742c8c4c35f5fa19e0a40ebfa60fc38535daf9c570ca3d7e012e1e32"),
    ("GFDL-1.2", "15f6a8d360ffdecc988c29279c00f23e20de17f14f2a06572ab0d41de6e98b7b"),
    ("GFDL-1.2", "1dbd72b6f124a1058e786b52a9d4afe44543b834a3aa44faf6c18b747c9de8e2"),
    ("GFDL-1.2", "258b994baebcbfece34df9086b537e4219935d99dcc89f821222baaab997e1d9"),
    ("GFDL-1.2", "2ac25285928a9ce6a8bde0e68e6d8ed774475113822c19df30f2474f15b171c0"),
    ("GFDL-1.2", "2bfb7cad161d35529e64dcca81918f6ca8c0718e801dd2e889ccb6017a81af5d"),
    ("GFDL-1.2", "33e7b0c926b6b183f54237ad056a663d10fdbb688e1b34a2c0b2d2167ef7b2ac"),
    ("GFDL-1.2", "41c4c75ddf233423b0b78a3c6be08fba886624d07af277e715b7aca9f1e074b4"),
    ("GFDL-1.2", "4586dba5ddfcf100fb8904f8e9ed3b5c8475c6a35c144d40b2c7904ea874cef1"),
    ("GFDL-1.2", "587d2eba87ab80a2aaa7b5f1c5b2d444f26a008dc483dafb38e27162fc5c2b7f"),
    ("GFDL-1.2", "5c083164ec08b233a6e2819c8c6d4f66a18fb74372858b0f8f418511dfd7adc0"),
    ("GFDL-1.2", "84ce1e08ecfd175909b5f1a7df90cd0a11e499c1de5accb1fdce50ab69d99de9"),
    ("GFDL-1.2", "994588f2266d45ab1e8811370fbb190009bebdc36ddc540d1ccb8fd6a392977b"),
    ("GFDL-1.2", "a1f0df2b18313280767d46545d9055f62d3e43865e62729dcfd6ec0c0c240ca2"),
    ("GFDL-1.2", "db6f09831916c5579e026e27258750ad20217e2fdecb30d0d8730f2444777abf"),
    ("GFDL-1.2", "e078a7e8620cd0cf62ca224a8d44746755f79bde8c966eaee25db83b042c9a4c"),
    ("GFDL-1.2", "ff70e77ff7419e7e0bdabf1b1173d9bcd37fcc97783d0f79bda24c836e9d2ca0"),
    ("GFDL-1.3", "2d36daeff2ad303badb6dee8149748be25e22974dd468e1e8a55cf40f16fc01d"),
    ("GFDL-1.3", "911b9e1b02471fa9b19ec482d019380acd7e0fef00ffbd4395e8813b06533fe7"),
    ("GFDL-1.3", "be68d33be24e4896ba28149c4f384a1bb29f6220b748d8ae6a580d56b0f62445"),
    ("GFDL-1.3", "fc6fcfc8a09b787d46f5061823461cd688e3982c62447eb912f448250a3f1238"),
    ("GPL-1.0", "1b19b24f361646cf4f197155866d72e9f0d5011031bb1351fcf10e24aa2f7b35"),
    ("GPL-1.0", "3b2524d27cb227016df68d1515394e8993b4bbf50c77d600de91a4399cb28f90"),
    ("GPL-1.0", "41020c05cfcb8b166bdf0c64e7f5f539feb5e7694933cf7d3bb79f6accd702b2"),
    ("GPL-1.0", "422dc6ece1afadb367f2bcdbf6ac496f4c7ad5c973c45cdd09ae377ceb4c8a12"),
    ("GPL-1.0", "4a0d740eb4453dafe0e6d04e2d2e4f04c7c85bc1fbef96bc056ea93e7c1c36bc"),
    ("GPL-1.0", "542eb44393b47446e7b5d9abb98b24262db09390d5986f0fb6feef9ead833086"),
    ("GPL-1.0", "5eba6902f4038a84a80879771855363939c7b81b83d57e7a776812d6d04c1b9b"),
    ("GPL-1.0", "5fcc149debc187a5439faada41342d88a9040d1fed00ca78f543889aa201bb79"),
    ("GPL-1.0", "6375a768fd262bf5281905a9585411d2d0fb4ea15cb08cfcba49f73fedb82abc"),
    ("GPL-1.0", "71fa4bd5fde166ce4fa896f8698e1bcf77024e8a262598b2ea4d3bcad7b6812f"),
    ("GPL-1.0", "733356cadf8ca8b0ac2db2d593fb7c1a2b0528c7e891f8a911fdaeb64719fff5"),
    ("GPL-1.0", "757ffb088f9f72935901695e43cf367636fc5a38bf315f11f0ea64e46f5d1ef9"),
    ("GPL-1.0", "7b86297a2762700b078231c8b488809b0f63cac5e298d74f4270d251bbef230f"),
    ("GPL-1.0", "7c09aae3c270285817b370de14a701a9ba0c7d9b56b1c3a7be3b96e6ba5ed01f"),
    ("GPL-1.0", "858bb219a7a780439b4bc4b70a09728cb4a536c4609a75c282fdaf69c8a85201"),
    ("GPL-1.0", "89f75ffda938e788be38679f9f83e317c2a03398fccf03ee60505d44d1bf9f70"),
    ("GPL-1.0", "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224"),
    ("GPL-1.0", "98c96304603be152968c123e484f744c9b51ebd341914aee6eea5c39133891e1"),
    ("GPL-1.0", "9b80eb3145b87968fde482b384ff47a39c81a9f3f04b7b569a2876c47d7ebdf8"),
    ("GPL-1.0", "a8a98615692e6d9738a3b77686ce468850d1e9a021d5434c1e1ce3af23286278"),
    ("GPL-1.0", "ac9f80a0d38a1e001427acb1e9fa5f9a23aee35e40ee2759901306fd4e382697"),
    ("GPL-1.0", "b80c75f62f77e4b5c92f32edee9a5be7c924cc651474d90840fecc602674a983"),
    ("GPL-1.0", "c0734228e33375b72256fed50d8056b50049dff71f408765af98cd4384a7434a"),
    ("GPL-1.0", "efcbd5d5f621ec465277efcb03890a7fae6d9253e17b05ef7d7c6f90729a0fc9"),
    ("GPL-2.0", "075bcb76902921614c275e6562daee18b3c9f48b9c4c92b8b99ba3df00093abb"),
    ("GPL-2.0", "1188bd946c8b086fe6ea384131bc5e4725728e74e0fe1902762c9c87ec4bd36a"),
    ("GPL-2.0", "2abe4f2f5ebff4aa8ed567a0cea0b9820cd074d9d7eda91d90df08701b51faa2"),
    ("GPL-2.0", "3f6302b11b06e2ba13b2ac80ac77a1979662ab69ce0b459e03a0238dd35d3518"),
    ("GPL-2.0", "403ef646951799380f6649a9a9c05cad95d64f4003a8c7476b27b490acddcf33"),
    ("GPL-2.0", "4767c85efb312bbe244abef9b752be38b44e810f05ed9bfae182caf068d13fd3"),
    ("GPL-2.0", "58f387b55eb95a9c5a6ef16e9064e1bfa9420a69181c677ee6eddf6ed1397cfd"),
    ("GPL-2.0", "5f3bcd48294d593b7647e36010d614bf45bfe3e5950aa6673782a092bbacc1af"),
    ("GPL-2.0", "6d332dc4c3c5293a73c6c9da402f9bbc970b3bb1eb472f577e00580573469808"),
    ("GPL-2.0", "78e9c9f811bd1ba04ed6d619d3e51a759305d2f124cee9defa3535ba4a24bd25"),
    ("GPL-2.0", "8fa94d3d812775805528fff117ea835ed908322b039e129b957550c1e107d3e2"),
    ("GPL-2.0", "a268f9c0a6d81f308a4286dac3b04b899da32e1ba02acf6eb78972ce623846e1"),
    ("GPL-2.0", "a96310c0126886e41d533f45005d1a2f38ac925a3bfaef1a8130b81d073307d0"),
    ("GPL-2.0", "aa75d54e4fbfdf0a9492e3f5d4ad1f93867a5fdd23c216c603d22461524ce1ce"),
    ("GPL-2.0", "ac164c60817349dc341fb503710f678c9f8afc5af87c7534931cf1bcd6e31e13"),
    ("GPL-2.0", "acaf68e303fe7610fff5b930bace57b87821d132bc434f4a104512da48f8bb6c"),
    ("GPL-2.0", "b1abfb46077acd6c0450274e16fe4cb4610ec546c090c5977a069c5f74340774"),
    ("GPL-2.0", "b1db576b0501c5696808df9f75d6c49f526e764a8f5a6dc589439bdd50b426b0"),
    ("GPL-2.0", "ba8b5323b72bf2f2c5d07074133b38292e0fa23fde8fa48771ba8a04cccacddd"),
    ("GPL-2.0", "cc5e906da6be25c1bd7043d43b6ae593952ed18b205716a7cd5c93213491d778"),
    ("GPL-2.0", "d111d1c24a44c987fb91de3ce5aab3ec35d8061a2c8a41ffaa8bb64c47df6960"),
    ("GPL-2.0", "e1270b653c300290e7c039142bccb8776f9b5d14e8a05bc4e87dc7d1614a3b34"),
    ("GPL-2.0", "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821"),
    ("GPL-2.0", "f285bc3733cac5b521b9507129b185a5f644847c954d9c5081d2405c9043b624"),
    ("GPL-3.0", "04a10e711844fe517f9ffba9481db6a825f2f268002c49184ecb8c942911bff3"),
    ("GPL-3.0", "092a7f3b82e6c22949b46388bca99e725b6e756f1c2b1e3f575447fbd44b6191"),
    ("GPL-3.0", "4868f466a3292b095d887ce2ca00548d3969efb48c33f6aced9a20c59f578c19"),
    ("GPL-3.0", "ac6b52d57c0104e687039148f7b8e370e04c9bb5705bb786f8ef814eb65e8636"),
    ("GPL-3.0", "ce818a0d5cb7a9a9261f63641713dbb4ca4750284738a6c3f546d86d81a541d2"),
    ("GPL-3.0", "eaab5d82fdcca441d83a1913bbf07e4de3a739e190578c0bffde24f84e93bb2a"),
    ("ISC", "40e6eb51c3b409d93549806b55b249c261dab149d19b56cc163624f39a08b1db"),
    ("ISC", "88c754c61ac1caf6de59b9fc87430730c097c988991470775d704e6bd3789acf"),
    ("ISC", "f172f90a892d869d5d840d5f4363218a9b21bdb1bd3925ba9c752d1660134fee"),
    ("ISC", "f26c1a94bd887544333cb5b1c999206e91db9bf18609b020ac6c5e91d4286765"),
    ("LGPL-2.0", "084782a05c82d5e85c704f06bab601971e84b3b9b90a51c95ffcff2b342d9cf2"),
    ("LGPL-2.0", "09bda551cd6a1058f0e9053b4e2fcc0bfb193e8bb1e1485734c5113235b4a30d"),
    ("LGPL-2.0", "2652838d994cbfd49626674c95d3dd21f6f86da9dcd7b97e2a33347147ba5323"),
    ("LGPL-2.0", "430627da7218a92ab4a6d75d5140cdb70ee750be7a53f913299b37e0d1b0eea2"),
    ("LGPL-2.0", "504542bce5421b0f5a7e63ddb55443ccb300b27a65ba6bfc1370fed16a3af260"),
    ("LGPL-2.0", "542237188ef845a737d1eab5621ecfea8c3310f513f6ff72ad59d1d500e84b63"),
    ("LGPL-2.0", "5ce88337a2fce97b0f2b6aac63afc49927c0dc31e15bf530a83e603e1d298d8b"),
    ("LGPL-2.0", "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908"),
    ("LGPL-2.0", "6e6982d8bb4468c5ce7a88e400f1540201513f39e8dd96e3607ee631b813c06f"),
    ("LGPL-2.0", "736aa88e50cf3c3ea93c80a3b9a349833dd1b381c6a9c336770f2c61822e164a"),
    ("LGPL-2.0", "81ecf332fc652bb79c23397a1431c72d1f39f01ffdcec61843942283b44f4688"),
    ("LGPL-2.0", "aa06ce7f6e464e73e65ec0efa0bc575ef5bb7059ae0137ab610c2e57b32ca95c"),
    ("LGPL-2.0", "ad81fc738f377aeba41fc24738c2e644becc9d2b6dc33ae94d1d1b9c5658fdd8"),
    ("LGPL-2.0", "bdb969a377f6160f4ad0ed61171a77004650a9c2517d62828be29f35b6bf6b31"),
    ("LGPL-2.0", "cb25e5e1095347e992d553a6b90ba28c3eb94162214d5bcb01d79a61f270448e"),
    ("LGPL-2.0", "cbc927caf696ef44b2fbebe29ffa45a5fccf0a64c78f2b85678a11032ebb3318"),
    ("LGPL-2.0", "cd0909403712694c9ea18a84f7dbb5d566c041db3dbd0e334cd930c31dfea7df"),
    ("LGPL-2.0", "cfdb5c66c66bf96ca974b33dd3db756e6c7eb3329f999c38c122137bdb4be319"),
    ("LGPL-2.0", "d40504a2bf1a1a86ee76e642ced31126577d21774b1ac0a222ce730ec78d7108"),
    ("LGPL-2.0", "d8f786929d4cd5e353f34a8b5fff503ac6cad8e24ee35ceb9eea0d2298b7b4ef"),
    ("LGPL-2.0", "dc842683831d008ff5f32600206cfd765e4d05df71fe831b1b4b31462fa2fff1"),
    ("LGPL-2.0", "e3486a0000bbe009f718d654729c9fbce91815811f5429e302cbc6cf9f016320"),
    ("LGPL-2.0", "f0daec6a0f573603d63948a57e952939050886941e593ad62f992f20e0a12443"),
    ("LGPL-2.0", "feb45efa998ac9d6ca85b1b2b7dfb124a14b1e88f579d2de38fe3a7970ce7380"),
    ("LGPL-2.1", "081a6ecff0c8e50ab92b129954441c5d8fbc8f1f5a8987bf8d9225cde97aee2c"),
    ("LGPL-2.1", "0de2e3ba00ed5f309ce9d71663e50ea414063f6e46865f2d80d4ad038f268c87"),
    ("LGPL-2.1", "127c98b05c4e2851a27843fcf90984e5592c3841d8a6b7638dbcd00bcefe46dd"),
    ("LGPL-2.1", "1d2a09e288311515cd0682b55db758224412a4901ca0578bf16420229d5190c4"),
    ("LGPL-2.1", "20136473d72f8fa2c8e3998adda1cf5676c9bac2bb48f059ee804302841a5fb5"),
    ("LGPL-2.1", "3bde1ca18489d8594a2c0c04b5ae1003c1795d1680675f4ef758325e1e1c3169"),
    ("LGPL-2.1", "48d2010e70a815a564f914b0c7c1e80d7a6843793348fed3684c957112fe0aa4"),
    ("LGPL-2.1", "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891"),
    ("LGPL-2.1", "580d668437368921310389889745ec2a76860b0f634a684ce33c6a4e5d106957"),
    ("LGPL-2.1", "5c42345581e1857951a2f5c540eae7981a9540e2d41028f448a195bb48dd33f0"),
    ("LGPL-2.1", "62470f8c7f6c88c1c89d5e4080fc0969a43f31055e91336c089eb0ad2152027b"),
    ("LGPL-2.1", "63a9e54a9c20816b2c240f12cda2ee7d6c9f2bfb426b706197a99f75ada62c9a"),
    ("LGPL-2.1", "77e5acffdb4b83d2e3ef8f1feb41cc7d5c859e0f7b2a31236b807ddc4248f9f5"),
    ("LGPL-2.1", "925c28788af11361f32b5b10dbeb4454be64e8448ed4a7c0926618a5d8a85bfb"),
    ("LGPL-2.1", "98d365a8217633113a201b5777e4d26ae0eb1d88079c5e39838162abe1f18db4"),
    ("LGPL-2.1", "a5ac783c64dc7fa3fe7b641692ee7b8da491bd87f613c9bb99618a9469e71c47"),
    ("LGPL-2.1", "b11e56f26e36c27490673d8fa272b68666cfd474b64e23db5244d0ccde21fa9e"),
    ("LGPL-2.1", "bd06b7347431b0fc243c0e32d1668ab362329b4a591386570abd310334f6fbdb"),
    ("LGPL-2.1", "bf2f0c6bf1c47b3b1e3cbedeefecddd1e7db21d1919858d45c2f918efaf426df"),
    ("LGPL-2.1", "c9369494bc3c8d01995b30224c6aa0af52dd5fcb01230fbedb398a6d454a03bd"),
    ("LGPL-2.1", "df8b7d554d9ba4683d95046dc0cd8fdf6c063841a3cfabcf242ab40e69237421"),
    ("LGPL-2.1", "e8379077377b4f1cf6d306654dca012e99fec5e9a13474071c353ba3557fc48b"),
    ("LGPL-2.1", "e94f6c31379c2076fae91e236d6000ea55d918637fc8f30749aa0fe22a265c7f"),
    ("LGPL-2.1", "fe1e4e79e75a761f9e18e6c55697cba51fe044489eb12d24fd4231b83ef47132"),
    ("LGPL-3.0", "13980739d6423be0921994d8ce3ce547437735b0e6733161f70b19c962f194b7"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MIT", "076dd180adfbc46869238dc50db0a471781ba9824d9759d029a7bbff5489da5b"),
    ("MIT", "1e3310b5520cbd869ea641227e30aefff12095d2b53bc1c7f71c636b6bcbfdd5"),
    ("MIT", "35a446201226de6b27cfb7106d0f6c697f63bfeac2913dcf89024911e66ef164"),
    ("MIT", "60fb065f27509fe6c4abe254c9695931e3b3f46343b35dddadfd90ca485742c6"),
    ("MIT", "6ad3654379e72bbdf8478d5c90fb1e2525aba033fbe675e0ef2248aac67c0f6f"),
    ("MIT", "6c833965e9ca4cf8095655005226f24fe8bf7b1605dbe513204837a7371fa127"),
    ("MIT", "7997184509e3c27d5e8cc613145133f710b72ba1925e582fc3f003f2fa4f394e"),
    ("MIT", "8aaafe9bdd25089ced51c4611e5eb169ab9aefc5127a5ead80777f4504429851"),
    ("MIT", "c20f7cb1c340aaf223de5fd1cce69193e961a0e7b35d2c53f47a6cafa85b50f7"),
    ("MPL-1.1", "2d5de14e5398e6783abfab51c2d2f9c108c9615ec98800fe1587a74c749209f5"),
    ("MPL-1.1", "8e0d6bce1c9edcccd142522e83c6de084a68b9500d79e6741b8903df3316c55a"),
    ("MPL-1.1", "fb84cdb331a381edd811d3017d5400ac2c74d9d8470038f79413ac78b10c2a59"),
    ("MPL-1.1", "fcb579371133afd771fed87cd5d8c6dc5648746c9945d4adf08ec5c79aba5c61"),
    ("MPL-2.0", "2cec6f733aa157c2d0b72e9669f75ca354f332218fcb5a3a885931f385272a04"),
    ("MPL-2.0", "95f6a0d094cf3da6a140310541c7b576789031b600469b70877b34f97918e4c9"),
    ("MPL-2.0", "e07dcdcc3b2c19db7e604dfb1498cc5dafa0e9cecf6ffc44f7c2b093fe9bafc2"),
    ("MPL-2.0", "fa31bb5fe4dacb07f1a4ad162be58edb552e9a96a500b68e081943eb2d3cfec5"),
)
