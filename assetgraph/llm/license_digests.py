"""Digests of the canonical form of long licence texts, by licence: of whole texts (with and without title and appendix), and of paragraphs in order.

Made with `licenses.canonical` and `licenses.layout` from the published texts; "" is a paragraph without words.
"""

WHOLE = {
    "Apache-2.0": [
        "0d5838e6f6e5a374e58d608af5c01bc6a67cf18552dd7b346e5aef652b808ee9",
        "0933e9fdf25f8a4aced10e10246650350123e13b939182f69b5ec6730ce2d793",
        "a657010cc8660623635462386107381af70d2c7ec43ab36e27484c72cbb3b28f",
    ],
    "Artistic-1.0-Perl": [
        "cc2cd6cccfacd5fb622fb0e9b9a373fa9dcb86a8c152213a2b856dfbe24fe304",
        "76edcf41e059af9057b484f27e804ca41bf305d16a20804a311a7c6394ce7f54",
    ],
    "BSD-2-Clause": [
        "eda2ad636e738f6a26a2fea902bb734ee48c789a5b40035b8db3659bd951e5bc",
        "a56fee4b2f66331ed54da4950ef9c9391453fd1490b4d8ea202bc29683bcbd30",
    ],
    "BSD-3-Clause": [
        "3d151449461c0c776e892a4dc41cac0d251eb00c9fc49d2d48802d9bed818fe9",
        "21ce5e311a0ef74591e636cf6d0a236029bcaa0ee86324ac68d5748657aa8651",
        "cf77ee3d20f4076cecdb58fc53aa7204c9f5c0651621abbc85e028f5b2ffa6b4",
        "9b83d3dee0616d07b82a272dd9bf5134a9f402b750f5ee6188458073b0a32ff2",
        "eabe215ff5a2cf5b1c090915b7cabdf511f70fc79fb8fde85247ebe3038a9658",
    ],
    "CC0-1.0": [
        "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f",
        "e3ba2aff64372f535373996fe68b166f9e97dc1ead5b471981213ebb8f310ad6",
    ],
    "GFDL-1.2": [
        "37db86be8f16e9b8dfb0d63e1698ad2e07d54f312494c1cb2dbdb4fa37487f0f",
        "df4a7e18cb36653db66ec9376c2dd5d138aec376a4cce12d4424a526290733a8",
    ],
    "GFDL-1.3": [
        "7befa86e5ee53162018d597eee81db6c727f3e64fab4641af93e19deab1807b4",
        "1f2021076bd507aed0cd904fc366e864f59df0192d296965d6b993c087505c56",
    ],
    "GPL-1.0": [
        "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224",
        "ee41c15ce7d9cf5f29010590a0e4f4a6412fc1af33c10f280017db3f1fa0921b",
    ],
    "GPL-2.0": [
        "b866f5427b78991db8012466b32f51c907f5e974fde5129a47372d0d0552e3a1",
        "e7bc7b2c2e4b763c9c6ceb90a3984a8273193cd39747fbab315ee26296ddd602",
        "e4d14510e41435c3eb12c255b72546a3cb9943f06f209c72bc30a19095b08999",
        "a1e7ba14d8d85807f384435b77f91e925decc43da128311c991c4f2337e44017",
        "51784fcce02e3d6a52a2ec0260f583b9d573810cf33e46bd16fd6a821b36760b",
        "4646298f1f69486a71cbb9951aa491f173f0a25d76adfb9a1560a08c75f15daf",
    ],
    "GPL-3.0": [
        "010ce52b3b970c80b5447205f4afc3b42084811cda2d11b95178b1fd3940764f",
        "be6cf54fefdf7da1142be7b1618883afb88c7df4b5e6b39786326b10aed10940",
        "3dcf77ad8c25248618918aaff1de8a2cb80cea6ca922ef4a7a389cca96a7560b",
        "3d4de016a08e1d98b27dec755cdf4530b92807d97aaa185b32e12d52942b1943",
        "c0c9bd5f6daa38ab99b2393ea1bf3fa29104890d97df6f0e6ee8151c8ea15e08",
        "890533e0e9e49f211db7a6295286b6854ac5f5560fef95c46bfc99c15cca3c70",
    ],
    "LGPL-2.0": [
        "9b0b3105b96203f9d9e4b72d4b77951152156c88139302b5aedf6295e3ceaaa3",
        "60e9e814f1805fdf9bff6f397e265654a66d4bcfaa9ee4e44c8a2977fdc1f978",
    ],
    "LGPL-2.1": [
        "cb225061bb71741fe8b31a2092e22fe05b1130438158ae5d16c48fd50186e345",
        "f9d8c63510acadfc6b74bb2f6da8f29ced84841c43b4548b8aa673c7d43abba9",
    ],
    "LGPL-3.0": [
        "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be",
        "13980739d6423be0921994d8ce3ce547437735b0e6733161f70b19c962f194b7",
    ],
    "MPL-1.1": [
        "f77c59051c0127d677dcce7ba0d4733294974749a7b4155250912498d92767d6",
        "096dc64932b51c03372c45ae3e3e5ed9a3973e7aa3d6ebfea629bbe174e831cd",
    ],
    "MPL-2.0": [
        "9e79a7d513376f6fa1500e4df4f6276c6e7e61c5c3e28dcdb1acee24033acc56",
        "a618081f7bf2f9966302de0eb99db3903b35dd0c8c819cc4c249806beae59284",
    ],
}
LAYOUTS = {
    "Apache-2.0": [
        [
            "8f9a07cfc74f13faacedb4ef5f66671824f4db35b0becf50739f877003b330a7", "93e3687e4f6d3361c07028c5c841dbe962c782ad1f86d4a2bd009e050751dc7b",
            "5e8200d69042fa63eaa665929691dfcc31c9c429a69a9c5659fdb8c74ff25e15", "c413f6566eac09deabd7dd17fbf82e6f44b7a8c3ad65fff893cda28143eaf113",
            "9755ca168c5ee78a587a0c7768784fe010efdabf561e180913751de3721140c8", "a6977de03549cc3eadb7953b9f93f4d4d14d0e4318ae5a3bc83c3d735ce759ad",
            "e763de90a530e9d38438df36422ae7c97e7fc230398fae521e54d5c2840964f7", "47299056c1de372c0948bcf8b1876e5e3cd4d18f054127be4e121e23175f5545",
            "e35324b03da62fb390c0ddb392a586e021d98e734e5c27f0ca086bfe37aa4863", "8c65e6dbd0943fbd96f929fc040dc93b90d20844fc8d51cbf5ad5c7ad9dea606",
            "4f384465379f141148dd40eac0905ce2283d3f89252262fb85430bc15c6d422a", "31256220e07c31cfa9846b2d86604e2d534e16e0bfdd7f38dc3f7081d1a55364",
            "0a1c56a3563d82505bd2cfd57c89416ed3b026e34ad9f0ad2950a673d211e7df", "9829ebc48935253378283ae99cf4dfe4d59227597be4206d7e26861d768eb2f2",
            "7e3a563f7dc2cd35596fca45cf1bb360056724d4652c2b036e3862bd89e98f7c", "b9536b1bb1f0c98d21b0be01436d2bd1e7bb1afb55a5843b3848b3c7ef3e09c5",
            "d2de18edc2f38c477928df228259bb8ed4cc9cf6950d1bde89be1281e6e0bd81", "21b8bd00368055c99e5135ab84dbe4fd8048879a8038bd7db7a96edf8b7f95ab",
            "5d09230c0c4a8effa82df658d3ed98a9898b4300f205086a221993833c808069", "c4ddcd6defb95e2ae3ae1b609ec8b017f2203efda6a4524b75ff438ae9fa5abd",
            "3f979f4e84fa3ba7d5471217f328634d260ce7b0d04aaf8d60273a9f20f23c05", "b6f8c70ae414c2b12d4f931b1a535c20f70c15e607538e347eee33d668b57093",
            "0fb2aaba4582f3a0b1624d72291f29e14fff2b3b4d085eb89e102cad1b6c26be", "9b801fa627a4f5569adb69d5059584f774edf477398e4a69c4899170c3808161",
            "268ef0e7c99876c159301a7339e8692e0f159603764d91daa6266de008c919e3", "56a893e2804985396346db1c6e1d8d0fe630553b6a83b70f42a5a10d53112d9a",
        ],
    ],
    "Artistic-1.0-Perl": [
        [
            "0570358f9b20d0503bbcdba2c25a24f87b07958b2453053e5e0749b359045404", "02f086eb77504748cf5130e6b17cc467b8b16d52b4f86c6237325033d4726294",
            "3534263bbbb78520545e50b4d3774b2102f79af62ac5ab153f842f5914b8b868", "26a5036b90c50f37bc8880e7c9933b79ff67a271fbf6902b8d41c99157e87078",
            "2d41ad6f9355ba20f6430d9ef57e995953581596a44817d8821381fd53483d6c", "935483456caf8461f64ec593942764fb3f7bb6ad61771c39d95355d0553c75ab",
            "026f1b877db2f0679ec986373547652c46e663ee0f09eee06f3f988136895559", "f0972b40700cb959d9156ed21a588afde1560077cb92020ce7a290c852e74d2b",
            "0c91fee77771917d70953c0c7ae021e6ef79ace44316779db84444a5a68ae984", "cc41408ae87eb3cf3a3fa2ba3d84bc806616c64096a7ce4f79e61794483f6232",
            "582b3c1d9c5b3e79b1e85ac3a61252db6de3c71541c32a14fd5da82936eebe03", "1d49793201788f397b5a36a79d65422d741ab6216ff625218d577b90b08ec61f",
            "0436fb927d3357b70bba24e62896a7ed5f4975d8466b895ca22ab9ef80425f6b", "b5b1adc2af5a40205acbfc45305c0e1e3ed291f16630602f28a187aefdb4fb39",
            "65a0d0e8ffba6ce692fb84fcc3fc39fbf206a3f8124146b0648a2ccf3973d0c6", "ef4728095fa172fd083c6e17d3a9983ab2889abb174ac439eb44ffe8c607ec3f",
            "1090ca30e4f915ac56c035c94a5d558bae6bcbaffdef40403462e37b6b1032bb", "d12e38e2e59a5f692ab2f22b23cf9f0aebacdf9f6cae5b7a6d5565e503f32188",
            "83b94dc94cd1c404db94084c1288adcfd2ba82c75756e52061381285a5819d6a", "65a0d0e8ffba6ce692fb84fcc3fc39fbf206a3f8124146b0648a2ccf3973d0c6",
            "cea9256897c4d377c32da8893506f8e0dd548cb00972f31c1212006bce104444", "9c1db0e3aefd5f6f4c3def481dbd25d5582dae24248299993a53df4b3daab3d6",
            "cbc8ba0d7705ff60d4174b264875b33660428b42509a420d2743e0a44ba06744", "00e575f715b4a22c0cbb4ccf69efb3684d9ca467d4d559428742315b09e3eed0",
            "4f85cbbd7a5ceb2a9b83a2b6ff1affb855ce45ad2e454e0f128a37ed76c1797e", "f3da3ebecc4d80033829864c473c2108f6af3f490765ddaa7e7abb9b55816273",
            "92eb9cd081f0ec170823692b9af05567b358b15dc1be2bcf6130b6dc7cedcc28",
        ],
    ],
    "BSD-2-Clause": [
        [
            "48ac8ca1db37804517afc5e6eb5afcfc70793472047f88dd30d536751bc2c369", "05a8cf32673bea2565137831121d0865d922256b8a4e95abe9491f6196641a39",
            "34ab2952b7b5e2216c1dfcf9194c817e5fd97567ebf714b3893d63e55c5c590f", "8840ecd4fe6d52fdb399755e5b2ab74adf3894ea580bf9360205303afcde5e53",
        ],
        [
            "48ac8ca1db37804517afc5e6eb5afcfc70793472047f88dd30d536751bc2c369", "59d6466165755b8cebc290f86ef95ad1997206b1ef4c8c08ae4a2ad2e5d287a0",
            "8840ecd4fe6d52fdb399755e5b2ab74adf3894ea580bf9360205303afcde5e53",
        ],
        [
            "77cffad6c66202eb6e42b2b3f9d9ff1f99592e7fe68330536f35dfe60ee2e952", "8840ecd4fe6d52fdb399755e5b2ab74adf3894ea580bf9360205303afcde5e53",
        ],
    ],
    "BSD-3-Clause": [
        [
            "b088bb5ec8bc8df2b482904c4c4efbf99594cfdbe7098ba14870390c4993aee4", "9d084adfa7789ee242110847fd7b7a511324ee5fc3e3e2ba972ea0e3c9acce16",
        ],
        [
            "48ac8ca1db37804517afc5e6eb5afcfc70793472047f88dd30d536751bc2c369", "05a8cf32673bea2565137831121d0865d922256b8a4e95abe9491f6196641a39",
            "34ab2952b7b5e2216c1dfcf9194c817e5fd97567ebf714b3893d63e55c5c590f", "c543de6e257741bea1cfbf4279654d76cb41cdaa137b0af2a12d83a25c49ab65",
            "9d084adfa7789ee242110847fd7b7a511324ee5fc3e3e2ba972ea0e3c9acce16",
        ],
        [
            "48ac8ca1db37804517afc5e6eb5afcfc70793472047f88dd30d536751bc2c369", "05a8cf32673bea2565137831121d0865d922256b8a4e95abe9491f6196641a39",
            "34ab2952b7b5e2216c1dfcf9194c817e5fd97567ebf714b3893d63e55c5c590f", "02cadc7ac61e871f2b2fec80c2c7a8fc276ea60398514318df06e36c7a9a6a88",
            "8840ecd4fe6d52fdb399755e5b2ab74adf3894ea580bf9360205303afcde5e53",
        ],
        [
            "48ac8ca1db37804517afc5e6eb5afcfc70793472047f88dd30d536751bc2c369", "30ed0e84a66462c425c754b84512435564fef6a743889c16624df15b50139bbf",
            "8840ecd4fe6d52fdb399755e5b2ab74adf3894ea580bf9360205303afcde5e53",
        ],
        [
            "6d3ac6320be50b2f5dacd1ad0afc0ede91adc28b78f88280c192ec450cb7f2dd", "8840ecd4fe6d52fdb399755e5b2ab74adf3894ea580bf9360205303afcde5e53",
        ],
    ],
    "CC0-1.0": [
        [
            "6306d25106a15ca126a9ad006950f3c3aaf90c8229437bfc7acb791aa3ae2c87", "258bc2759ea2cb9a64d69f2d91c7d8e4f1a88d1688b894fe7485b5d5c701ec58",
            "24279893481296e429db9bc0f5aa3d2339beefe5552e73b54261614894ab4d86", "025b47838add4cda9c8fd0c028a30441bdd11623782c25fb86e12c1d19c8d043",
            "a30e11290a86a38b2d5aebffbf46b096b10e279b86152eaad0ee0388a4cfce61", "8adae8faa63004b20c54ba7e618f3926241946f209459aaba22619fdb3e71a1a",
            "7bb1f351459665661202f312854eff12b5964c639081cb063a45db4fcd892af5", "79957adc11167b72198663bab50d00fceb7c56c33905cdc5066f2c0a6ce9df21",
            "4b66fb51100879ed9a82640e9bdaa244ea17509a3d66f8a6f50c54e575dab133", "b7e3dda976778c49eb8ec309249f763dcf441a5c6950d0cb5071e898fa64c055",
            "4ed62e34c78f973f9d6d5671c56910faa5a6032defec5f08726f85473ff0993a",
        ],
    ],
    "GFDL-1.2": [
        [
            "d093a38219ee3a62fe302fb63439ff75a2ca95cbb906cf96a4bd33341df9b267", "d5dd271421fb47626550b2490cff8c3bcf7b543096db366f8b90a23d49a230e7",
            "ffd9cbb86b506d4eaf39671a3ed1916dfa5c78395118648bc8fff9c317622776", "7235eb1fa53d96ab2e2bc3826a791715fc300317887fbdb81865b2e5e9ab3de0",
            "edac903f23b3d0b3518599eb5d1c1cb212c760f3e773fc67e7088486eaf2cbb8", "4a82b7db0c80378824dc5104fc104cfd1bcab98da53157518ce6459870b38ea1",
            "58f56917d10a4e256a0646fcd6950bf4725415978b5d8e1370de7152d87866f9", "239670a0259b716f258b4924b7af150d9c7ba50dcb10dd0bb456c7805a6a14d5",
            "6624bef9fb98ef780836b1db171a161889e037fa755daf13107cd0b4a55a2876", "5fa0dda07cb5184cf6a9100d492cb5d2cb9f04065ba24f3f594a73e0c255a6aa",
            "cbc68a20fa863fbf9443143b1f4ae910f95fdecca8699aaba9599806f46696c2", "e4a1e57f9f435965b9a55654cfe44e125b3c9e005632753d3534b44f0f4a206c",
            "967dc89b2ca094fa7064c23256ff50f8a129182610bd8a11e90e2808eb80c35d", "7dc48d09082c73e46bc0c56d4596a989b8b741d322e57087251484277b2d690a",
            "db6eb9a432fd54ed050cb271fec4a0879a2edc1fd610ee922aeeaf95a55929fa", "70b167b78b2b831bbfbf509341d2b4644142ade9baf9262a5c60411dad8cb836",
            "1e404ed2fd3ad96d2b7120de85fb631cb802220057214629aef1830251db7a3b", "564fd5f39cd323d76ed228ec2dcdc0583832571ccc768a0318828170155b034c",
            "00cc1e2bd0b26b1286ebedeb47865be95ea4135f0d6fb39597334f6a4f4123e6", "f37f33b63bd948d1531389fe60306922169a5d5cd0336a2b949ef2b28d1f1644",
            "e305540b82dc9c79a55d984d80b901ffac60539c8e68643ed5cdc96b74448971", "31b4d47ff2fe9e0cf056eacbafc87e4c84a57236cd4686f295ec637f31bfb567",
            "8348e7c372ee0b6e2dc40f98a56299c5d43c219ee756a0947b17a3f350bb85fb", "bd225944db54f562f7691e839b50014e5fd6dafbf9d5a7bc7fd22c6e1a1b4c84",
            "d7b0855a4af23bab8d44bc833ffadd66cffa1b01f379b1e21aa5f6d660d2ad50", "aa5b684158f44eac27ded9316d0b96d9882e1e8d803a97b8298254bb2c79fa11",
            "6706780d5092660e7a619a1ebf9ffac30ad01c77e1df10e494e6fa8b8de81de9", "9904d6725b29e567220643410be424837341f61915acc24fad80131bb017a58c",
            "0fa0e2cb0c6950d08cebf64249e44fc19fb3d970c7886574accc151c56767d4c", "b48a77bf944b0aaa311c9459ced8b5ed0e71e93c6863d3f8db46988ee0343140",
            "737156634ce6acd54b47100c3106aafe929040e4887b46155d93b84959061d8d", "f3b4b9f1ad6deec2ed4a8c93337b11658f94c115046d06f1e731b7e6653c70fa",
            "3c77bf4976824ca6eb0ea5b05f3cff79aa74ba778302393354a189db5e40f99d", "d60dc25808aeea040f50ad0bbdb482cbaaf2efaaa225586787abc1ddb39ae4ec",
            "976618724355880ea41bb152ca264f595dd75f4c333553199314690173ab8328", "0cbbd960f685cc48e5e093457ed8d458f4f214466044c6de4c9eb85d0290a93b",
            "1fb18fdc326175dbbc0cbd7b3691d15f53491f293c068063bb1cac47d5e3c089", "fd2655b934552b93a1ba5fd6d90b849e5d69daef4bc63ae41381a67e3801a854",
            "aa8976ff6775fc655b3a42397eb76184ac99b6c9b52ee3c4c86f737210cd0ab5", "24d6e1842e3832c2435e763e134dc70116cae6534784941dd006d848738298fb",
            "8066fbfc0c2250e93bf9da2c92d67a6e16d9963cc7518946ba51c03e70957b63", "0b81cb06867df6f75207433e8ad6794c02a14e422175ab23b15697981b3ce80e",
            "9d86589040c61bed27024f44402b3fe0da3138c8f0952d1c01a331b385400db5", "60f7c0363c8a6ab4d5eaa11f6c154d9b9460ad8e15f5496e4cb011fca3accad1",
            "5e3ba6934ac9c18789b6335974896c9fda5dd5f7984f22086113bb264d6c0435", "0c5102e87c13f076c1a7e0079a7bdc1a8bc114395f308d262a05c835c7d718bd",
            "0727f47bb2ef0ba94fc2e548e26b9a3069479758f55960c0777f554dfbd338f1", "549b0ab7ebd9e644c6778fd7e176643cc98ac87cbf726102511498d9e603107b",
            "86c5d5251aff2698dc183298c43116db2cdace0b472e8e96c1c9dbe444e53f2b", "8fdbf25ee440a6f48b6904fb9945d3c154bc1bdc212b6cdbf8a0204591e6bde0",
            "6fc07465c398129200dc382361153dd460dbe4de29396b250cbd7dbb2a1e191b", "b2676b371a3c66233a13c161e9279791ddbbb40940a9bfe4b212f1fb7acc59d2",
            "c746f66f38ddbac28c81c5f45e0bca5a732716dfc772d3f2b2abdd0e2c50f5e9", "967fa6e4b38f0fa30651100146851ad69c6648c96df83c192bda664969141d7d",
            "aa518b451569f5c907538bceffb83ffea839c5d7569c456103960cd0d2385019", "22036bf8d3f282ab5a8a166fa766b93be638e78efa9b4e851bfea7d74945e956",
        ],
    ],
    "GFDL-1.3": [
        [
            "bd9107c2f46302748a726d0e150b7dde8ebc64c09c903dafef85a814f9cf0a87", "d5dd271421fb47626550b2490cff8c3bcf7b543096db366f8b90a23d49a230e7",
            "ffd9cbb86b506d4eaf39671a3ed1916dfa5c78395118648bc8fff9c317622776", "7235eb1fa53d96ab2e2bc3826a791715fc300317887fbdb81865b2e5e9ab3de0",
            "edac903f23b3d0b3518599eb5d1c1cb212c760f3e773fc67e7088486eaf2cbb8", "4a82b7db0c80378824dc5104fc104cfd1bcab98da53157518ce6459870b38ea1",
            "58f56917d10a4e256a0646fcd6950bf4725415978b5d8e1370de7152d87866f9", "239670a0259b716f258b4924b7af150d9c7ba50dcb10dd0bb456c7805a6a14d5",
            "6624bef9fb98ef780836b1db171a161889e037fa755daf13107cd0b4a55a2876", "5fa0dda07cb5184cf6a9100d492cb5d2cb9f04065ba24f3f594a73e0c255a6aa",
            "cbc68a20fa863fbf9443143b1f4ae910f95fdecca8699aaba9599806f46696c2", "e4a1e57f9f435965b9a55654cfe44e125b3c9e005632753d3534b44f0f4a206c",
            "967dc89b2ca094fa7064c23256ff50f8a129182610bd8a11e90e2808eb80c35d", "7dc48d09082c73e46bc0c56d4596a989b8b741d322e57087251484277b2d690a",
            "24f308654a4530485716218bbce0db461ad3aea4f1bcb7a52df89bf3525dc70e", "db6eb9a432fd54ed050cb271fec4a0879a2edc1fd610ee922aeeaf95a55929fa",
            "70b167b78b2b831bbfbf509341d2b4644142ade9baf9262a5c60411dad8cb836", "1e404ed2fd3ad96d2b7120de85fb631cb802220057214629aef1830251db7a3b",
            "564fd5f39cd323d76ed228ec2dcdc0583832571ccc768a0318828170155b034c", "00cc1e2bd0b26b1286ebedeb47865be95ea4135f0d6fb39597334f6a4f4123e6",
            "f37f33b63bd948d1531389fe60306922169a5d5cd0336a2b949ef2b28d1f1644", "e305540b82dc9c79a55d984d80b901ffac60539c8e68643ed5cdc96b74448971",
            "31b4d47ff2fe9e0cf056eacbafc87e4c84a57236cd4686f295ec637f31bfb567", "8348e7c372ee0b6e2dc40f98a56299c5d43c219ee756a0947b17a3f350bb85fb",
            "bd225944db54f562f7691e839b50014e5fd6dafbf9d5a7bc7fd22c6e1a1b4c84", "d7b0855a4af23bab8d44bc833ffadd66cffa1b01f379b1e21aa5f6d660d2ad50",
            "aa5b684158f44eac27ded9316d0b96d9882e1e8d803a97b8298254bb2c79fa11", "6706780d5092660e7a619a1ebf9ffac30ad01c77e1df10e494e6fa8b8de81de9",
            "9904d6725b29e567220643410be424837341f61915acc24fad80131bb017a58c", "0fa0e2cb0c6950d08cebf64249e44fc19fb3d970c7886574accc151c56767d4c",
            "b48a77bf944b0aaa311c9459ced8b5ed0e71e93c6863d3f8db46988ee0343140", "737156634ce6acd54b47100c3106aafe929040e4887b46155d93b84959061d8d",
            "f3b4b9f1ad6deec2ed4a8c93337b11658f94c115046d06f1e731b7e6653c70fa", "3c77bf4976824ca6eb0ea5b05f3cff79aa74ba778302393354a189db5e40f99d",
            "d60dc25808aeea040f50ad0bbdb482cbaaf2efaaa225586787abc1ddb39ae4ec", "976618724355880ea41bb152ca264f595dd75f4c333553199314690173ab8328",
            "0cbbd960f685cc48e5e093457ed8d458f4f214466044c6de4c9eb85d0290a93b", "1fb18fdc326175dbbc0cbd7b3691d15f53491f293c068063bb1cac47d5e3c089",
            "fd2655b934552b93a1ba5fd6d90b849e5d69daef4bc63ae41381a67e3801a854", "aa8976ff6775fc655b3a42397eb76184ac99b6c9b52ee3c4c86f737210cd0ab5",
            "24d6e1842e3832c2435e763e134dc70116cae6534784941dd006d848738298fb", "8066fbfc0c2250e93bf9da2c92d67a6e16d9963cc7518946ba51c03e70957b63",
            "0b81cb06867df6f75207433e8ad6794c02a14e422175ab23b15697981b3ce80e", "9d86589040c61bed27024f44402b3fe0da3138c8f0952d1c01a331b385400db5",
            "60f7c0363c8a6ab4d5eaa11f6c154d9b9460ad8e15f5496e4cb011fca3accad1", "5e3ba6934ac9c18789b6335974896c9fda5dd5f7984f22086113bb264d6c0435",
            "74eb38dcc2fd424f33041e63f8e6198243045f4dc55b65455f7f74033e81a8cc", "e9809a959d6872db36eca125fc35dde5086eeafd9a19ffdc28e22bdecf922205",
            "c8c896e6237ecf0a7e7e5bc5534fdbb16830c71046879ea2b2fab51d2cc22cbf", "2cc7a63a4eadd66bd274551ae863008fcbc991cd05ca99c61d8887d6a82bebe6",
            "0727f47bb2ef0ba94fc2e548e26b9a3069479758f55960c0777f554dfbd338f1", "549b0ab7ebd9e644c6778fd7e176643cc98ac87cbf726102511498d9e603107b",
            "e2e54aec5f73259da9813dbd149450ecea80593073fcb57f918c2a8d1e5138fc", "b5d1f416ebbcb311a6dd788aeea8e3eb8250a8195f194f579c9c903a55f10136",
            "4d1357dd6aa8c413532383bfd764530df28cab5118ef2eab946048be941540e2", "beeb7b93c5a18115a92a3dd5d5db78c2324359b14d4cdc71b2e84711fd396cde",
            "184a06ef656852f2daf2eab2f3546c20fa37a84af2f78e3c415efaf7104ff7ca", "506041ca9ad197f01996cc297c7822b36554b383916e4ffe3380c0daee676e73",
            "eb58cb6f044c60d90e782e735c588b22a5102178059e8ee0c98b6bc2ac2527aa", "8fdbf25ee440a6f48b6904fb9945d3c154bc1bdc212b6cdbf8a0204591e6bde0",
            "6fc07465c398129200dc382361153dd460dbe4de29396b250cbd7dbb2a1e191b", "2f621a218a1d890d14451649e7c17d7c39dc0ca94465d61bf5eb9d954b08445b",
            "c746f66f38ddbac28c81c5f45e0bca5a732716dfc772d3f2b2abdd0e2c50f5e9", "967fa6e4b38f0fa30651100146851ad69c6648c96df83c192bda664969141d7d",
            "aa518b451569f5c907538bceffb83ffea839c5d7569c456103960cd0d2385019", "22036bf8d3f282ab5a8a166fa766b93be638e78efa9b4e851bfea7d74945e956",
        ],
    ],
    "GPL-1.0": [
        [
            "aaf9385eedc0e8797f25532c8f623c05bba02ebe7b124aefa1352367290a485a", "9a9b9a1c3f54a244a0f9fe66967769d25f166dcd6209e2c205ef50915e683bdc",
            "47c0c82313f5cb7fe16a46542a744a4003568f8d82578eecbf540beb8538db48", "db886688a80548c4babf01d4ba9879a258631dc65edf3fe72485732598874d91",
            "7ea3490cd136e23f34f4e5bc2d9148016b5c28de6067f6295412eeb3426d2198", "3722cc84c57c8b17f00c4f44db3830d77b4a780fb69a7638b5405927b33f90f4",
            "18442fdb3a23bbb1a6623619cb6ee2d71ec47f05f1d4de10db4812d23a94dc0d", "fd67f194410e043215cd5a4a333c7554828a31185aec0418c19882838fe48d56",
            "f0ec38b66ec86b0ca81f8d40af33d686251f516773959ad546289fba9c83566f", "4b3a2f51074477b0a310410bf82471921b1c2c36b2075a6a494cc2656a525afa",
            "0ce51885233fe93bd7a178ef07cc5c5c5d2c67a73959e6ab929fb4c836965975", "b304eb4eccc2a9bff6cbe38980f979ceed9513e50fc22f8482aec81c3763735c",
            "55671c01e5247c9861eb7881d42d41ddf720dd18452cef68a3209f9f67de083b", "7b73ffd7af740201afcd1497317cb75a9885c87c99f3903d5d3f25ef5b9a9f8c",
            "144d18d8c9114c3dd9a68912281b5a58590181f5ec991532cd1689d387b2ff33", "d6e670864a87d967339b9a0dbfe3123c21a84c705d4835e0feaa6f1e46d2e6f0",
            "a5bf98ef1b77b181616fe8361cf8b7ecd1fe282ee803a6d2241ed98f835be26c", "71a836946d04826a755da3e9401f1187be1b3385fa5b7a7b449d00f0e731b282",
            "515fafa944a434250e9b58b5d5564fa42dc337f51301d4431250fca15c065662", "3f17afaeecb04ac06f3c03a404140e3ef4ace5faf0ccaa7eac04d17a1ba272e3",
            "6ca5ed8e00214b175290aa04b107a7a8d806fb2fd06a7cec51e68f6304f06667", "c3e77bdf9faec8255e91d76af91476f5bc0227bdd47bc931ea8e692c3bae81ff",
            "a7c5aac79884753756fbd795837ec3f54d49997f79f6f8de62a3e674a7514e52", "923eeee00ae01267df289e2469d717ae742ce51393a75e51ab0127f3eab8b4ee",
            "b9f35bfe8b9b4d91b66c63d8fcb22a1b4b1dcb3b08663243163e4c358d6312d2", "4a0cc55ae79ab133c3e3dd79f984d5bdeee5117661d112c5d10b42f48df795f7",
            "5f948da1f3aee4c914e38c63bdd865e42ed584c41591abafc94b4cca5add969a", "dbacc6de58570af1bd9b8206e86bd7200e48eb67e4c7c810043068c009e7a738",
            "cf78ecfaae7061a5d693875777ce4c2f88fffdf9ef6216c5c7a2d1cd4678417a", "298eddde6243ba90c7dab05132a15059a4091f9dafb65f9fa2f183c432dd9780",
            "849b89b04efd12b4d557318c03dd4ed2fd1e81040dc9ab201e5f2d038728d533", "3da8fe3ce0fa46667c9a4712bb7c634a6e0966d16fea7874e5d6698c058159af",
            "78be0ce2ec46e15d8907d83644caf6a98cbfca61e7e520613013f15755c286a3", "230eeee75b07fa71e4b1823e952c8e16292a543503bddcf2c8167da4b47a93d5",
            "3153b45862d1631a85b2cfb2be7d83ee1d7e88f4b08cbc833623e8d981d33b2b", "2614cc0e65f191976e74405d3c928aaad4131e78803e42745d43fbe32716ed1a",
            "08d075679ff0963d137622c6ec2e74bd9935d52fb8321c26b972d108f21a834e", "be346c0ff74cda7251963e0370ae4a19536bae9a7f5b4544e345faf5a497d9d8",
            "857c028326552befa27bacff490198ad2b871694080f33cec737e9e47643d2d3", "81b82df18e626ad4a8d2680cbae46cc9cfb35f5e7fb00ceff61e739930d31c77",
            "89e4049c2f963f84d36ef6498c1310b7ee19095c007698eae37319df7d301957", "9301061e12f773802062d734460204a72e5d73799358545b22b95b74de12f57e",
            "c0924fa00f68b8b4e2a4f48068b66a29c16b6fe34dd9b54a974725e75bb04551", "b3143badf03a3c8ec5637ec52198279304a61d088617f093f4d8e74eff48aad3",
        ],
    ],
    "GPL-2.0": [
        [
            "d096b5b4197a10a6073389fa1f08a8ee1e0ce8ac1ba4b34a698d58a2d75e62ae", "9a9b9a1c3f54a244a0f9fe66967769d25f166dcd6209e2c205ef50915e683bdc",
            "6aa321efd90694f9c4ba0adcf4fa70160926c6f078d82d5ef4094c375f87769e", "b9f10dab996eae3d9199ad93dda312a3d8d7d43c2db83958ee4aafdd78f61be2",
            "7ea3490cd136e23f34f4e5bc2d9148016b5c28de6067f6295412eeb3426d2198", "0f2c9ea9e20fb47269d12c6e25c2fdd1982cd2d835a776b986a4b38992b7e9e5",
            "18442fdb3a23bbb1a6623619cb6ee2d71ec47f05f1d4de10db4812d23a94dc0d", "fd67f194410e043215cd5a4a333c7554828a31185aec0418c19882838fe48d56",
            "40c62f66b64726ec07608219307e215f7d824b14470d0101470959196f14cb9b", "b56a5e74095a5a82fe5abfc423bf152c935bb7105a5897be9f3faceaeb9ede35",
            "babf4896388ec979a002db2fbc0d24076cecd03256f32b99565bcb76eab5e41c", "719b3bfcf5bd10a41d53c8f1cb072a115c76f2359f86d2e1158670ab3394064c",
            "bf0481752e479f66d03d738bcc0ae6bffdf66456a253dd38fe1091defd3bc1cb", "21c61a19e42435184725d24433e55696ef76cf97a37b73c90e9696b6255a7e61",
            "412f56d60a5b82134efb7d5998f8efef7cc134d9ac9f51ce7927b16f1a205808", "ccca24795f5ec24af309c27a8fb82171b52f5db8b64bcf50626f25b73187e061",
            "c20ee2b91266866b6f20f2bbbe2a9f35a7f86461331092094dbfdb967335dd67", "1d31b6060ac2bf08784c1f311fe96e88c5b4434d0c417bc6391967ef81042a94",
            "00e71c0fd4099ba404628a4f53429fe46d5e59a6b5591a26545bd0f1265fe680", "a0c65833a9a85f467d2bdc74073999de0d1ada98b8312696747552d4c89941ad",
            "adc9258d0c598ca8cbcae2fe7a9ed4718e19124485e0338d3474c910b07b293a", "854448fa7d3934cc22680226f4b30e4e3daedab5d549bc49d3c6afa7075c8503",
            "b1e466c20b4614a3ac675e79f1e769950bdb052a72bb229f2c4c4d9dbc765dfb", "b95bada32fe670852bac8e8059f0e69c629397ca051563b0ad1339355ea2cdf1",
            "2d5954b33de95faf474e74d2c22aeca54785cc26e83f68b35eba0e90c9e27272", "30718481a7d53d306a81ca6303ff3cc9dcf238876a61fe9ab6a099612bf634a9",
            "ae447415c255f2a3936f7005c0e0b422e0f04e93c2bd8dffdaee9264b233f136", "73b9d40c6b6c93a01e3ef46c7c4a93d3f96d4b4b61329f20fef0c4a635be5446",
            "92c00e6c4f780933a542eb23e92892df678697bb9d17be774f7be235e253d1b6", "9e7e4b1a40dd0f2b32bef2a3f62bb68e7371edcfdbec9b483c4aede5354aca7c",
            "1f4bbc5844c13cb68799771048c3fe6de06a575e5a4f162b4cb7c3c9b1456971", "d90515934d9469043e390910450718cbabbd46370cd4dfe790739b04aeb2cb17",
            "f3207b47b487e853abfca43d83ae4fe7af09efddab0dbfc566c547d2f05715ae", "b37d69ead60104eb364fbf3e98df6b55fe5a7811155828427afc1dbd37c59961",
            "1c7df6a7b7b0ab7404c8c4f6ee23d7da62c92f2a1fa87892bea27ce3263b4c8f", "de976b4891cc7df3d25535dd9b6f5deba927b869a33c3048898bc97eed7fe700",
            "98cbb7ed55bb5d0790479ae8bc8407746831f55a263c5863e232092f9fb2337e", "b1ec7f09b7927665c6df7da358579b6e4101ea4a3f7040b8441f304e3e38cf76",
            "482b6b93621af9bc784bdf36e10ed2020dfa6dea1688cdb85d86e73f5dca77b5", "5f948da1f3aee4c914e38c63bdd865e42ed584c41591abafc94b4cca5add969a",
            "134e8ecabacb867ede1aad018bd352565dbb720c6b48e0af40725938d3dcd07e", "f916631d736b4a41c2879eaaeaf396aa17e70b9242f9f8dec250fe034c199c21",
        ],
    ],
    "GPL-3.0": [
        [
            "aaf9385eedc0e8797f25532c8f623c05bba02ebe7b124aefa1352367290a485a", "9a9b9a1c3f54a244a0f9fe66967769d25f166dcd6209e2c205ef50915e683bdc",
            "b9bc58918452a1fb3a47d82e6b0ab789ecc90bb85624102450640619c372c2e7", "9204574967ff29bd5324d190e2bd0c132556c8caaa19b8448500ab0df84b4a4e",
            "64b202428e57cc43a4a9c70a466ca5c308c952e4c66ca8d7979d5c7642f331a2", "f77f6a478405269321651be66aba4f94e25cb99d4dea96713b975b6eae309ff7",
            "f04c738485d21da8f8004139622fa7b5801d3fa95834d3479042d01b40a4dda1", "136fd365f4de7a49aba9c93484456362b9cc57e273be6a6ca953cd97db0bde34",
            "a734c82252487b89f0cf19b351250581bca3609bc4caee786ead0a7b97657b81", "e1efdd7f3eb2b067be4a313b69e8d074423a7d09e3891bb1b3264bc7081f67e0",
            "1fda13a050511ac96b46be3a1f281a7f20a324c577d29b7a98b58f9d7087a7aa", "b56a5e74095a5a82fe5abfc423bf152c935bb7105a5897be9f3faceaeb9ede35",
            "e918ed85b7fc2eeeaeef3c049261de28f0980e045930b0693c17bfed7e57cfff", "275d388a3b0fc15b578b49625b2fc4b865dad97cdf4f9c29539f2d09d7dd04a8",
            "48526048138c0bc995f14796a50672f1789be73d71f85d5d4d0acf2d6a663a0e", "34e0d5d5682dcf814f203ff33c9fe4e5bc2cab1b44e98ec51f411cbf718a195f",
            "5ede777885330378a4cedca4532dbf8298393125f34257b2966d1449b1a002d1", "b793c33bbc9c0c88bc6e85db4ddeb7e5860da7d59e1f634026dca5d7e79d98d9",
            "3fc11371b34c462bf0450d3b98bbaad1e71a668641c44f6fea5bccf8c87e0ff4", "78d5ed94fb183f06a48a249ef677df53da0097e6e627f2f413fcddb8231fec56",
            "b620aabcc5545563a9d488cd117d2c19acef2433c562326465c6f6e3aebfcd07", "9e2e62c9027ff561f2b2de185149caa50f96f8f3a805a917f8aed88a313419de",
            "8b5e816100afbd99e68e17b1380cddb518ffdbeb0d24a79e187f6d23b4beb698", "3df6d95e0b8234cc89e18f7061a9c82f6b7a8c7f019dfceca16fdc9f7b8951ff",
            "20acb9b739d7fabc9a502f647e8e015f6a3e477f42b5b31d6c965390491f684f", "b73a5538d4f7abca25b508a9910d877de65880761c2dc76bf1f978b05bf16c49",
            "5d2681324e10799f26af9a1582b6a54ea5faafd80ec201955d2e6aab40fac857", "dcd3c6fcca231313b52d260ad9c871095347b38ec6b1accb5e1c4f93afec762f",
            "52613b43b56eda263aecb37204038319879480bb85440a4efc5ba169c8a9455a", "ff67fe18b0b1698e6315f1c4195b75047c965ff537c80d9f3ed813f1c786f3a3",
            "97a663720b2ffcb096c68ea14c7f39c9aef7ec4b32b7fd707e5aa46b41b8adfe", "6055e3311c73858c543bd371d79173e9a6a49130d8caabcd64c2cb58941f84fb",
            "75b2a83776c2b4a0c79cc55aa46b4d1b3726489c53c94eb3364bd88802f9c263", "2e959c6c86d7b151750f53828d501e04bc6c88e739d41856006a8bf55594611c",
            "03816aac4adece42af2a31b8e2b9d64b52565ad209a3e9177ed41ddaad20314b", "5ef37b771ae0f9036e1ddf2e3cf4401519a0b81ab79d1bb201c658ade8924fc4",
            "650d5fd72926666d2d629b0d5976c62436c40df01b9db7922d278dca7ff1d84f", "a942b4a658f4ba3d3d2a99533ee72849668ace15ed4e45d2aea800a71e171330",
            "5007b9bb186ba0fc8885d25c6989b1873c0fa93f95184ce1bd4a0de81fb48624", "83934d393d1c935f198ef3a815f795fd919a98de60f637f404ce40d920fb01cf",
            "a8eebdf652d28341aa50ece8b556bc52d1fe208c63d94f48e03623bf08fa78e9", "e2f4306c1ca460cee0ff228828abdea62b208c41d3beb146fe10ae126d49d267",
            "6e67505a441cb5c08c6b031c47ac23058c5870c19bbe8162d118b1998462dd14", "05f64e29bad26d6b43e04a0bac7175839112e5e8d1f595174a12e2bcdf844834",
            "e0bf7038393e1b5d2c3fa162791b74ac42e5211e59420a452a194411282265d7", "cf4e80eb3932af36efb81482fe5bc3d3765be975d254b35250dd49ed81c01dda",
            "87eaf715ae5abb2d7139624b290edaf12975178a1142b339a345f21a7a116657", "425dca8dae1f1181a73885cf809888f69652e7e83f890a8dd7db7a867e53bdfd",
            "2aa625a9d7c8d410d09b9257ee458e9de4b1a412b1f31f1d3b8d1d83265f1d05", "16bb8dc9fdb62fa67e975eab3f9ccb3564c9c96bc3abd7dad172470326a50c12",
            "11a117bba57869bde15075b61f81946599a230d8556694225fd4ec965e365f2d", "38c710ce967ceb8f18bc15ea39b3cf61d8de3e30b20021f7225a034fa40b64e1",
            "f2f329f3fb35a25bd1ffa629f1a847c821962d9f87d833504361c5728f71c2bf", "2b168657ca31a74aae1a0396ad25fb083e85711017173748e264e2d423f3af21",
            "7d51c00299f5e4bd54f6674c88cc31b5a7b924dcebdfbad529e887cb232958c7", "7e069d3a37eb66682e5c057cce22325ad5469678ead13882aa6207e3e8bd3fa0",
            "ef0b400f97b30948eb078a7c643e8ae92b6c27639745709c17d02608aa5cad21", "7bcc74a18ac967a95547d1198591cc6da8dbac4f56a0068c354eefd66fac221d",
            "958afff48b9e0e489c2081ead755577611c793db5e6897a67a04606b7deb7c67", "3d02334bbdaa31b36e6a4dfb85ddcf5be4cd8dfd3f8a21f9c4a1d7e20f9dc22c",
            "fe5917ab958d08d28c26152331e789eb9dae40ff64dc1b8992fdb35abaf39af7", "7f49f94647264c581c2f3ebd85c267cc2f26b7e009dfed3c8506aa5eb813603e",
            "328c8bc1e86822cc6c32fade1f40c0c0a934b3f86c0dbf5da98c5cda387f0adb", "9aa2eeabf1930117299d2143e29b2cba52db448fdfb35e8dff43d78fb60aee7e",
            "04baf379f745729f744d0e3f4a74570328082f8e91e146941a3ed7c858d01d0b", "05098ff75cb75429b5e0a86e3a8ecd9bab840fee31ee7f352381ef9414e2b2b1",
            "268c4a0109d675d6b4276fbf70d27085968159d98e503e1d960dc7164764479e", "4889ac662be541e72c741c99e6fae51bfe03583e12f88988bbc110330cdeed38",
            "35c5f7f8a5ed6586bd8f26c554c2f614265b2577652036deb811c775e8652ac5", "ea7b4aa09d092b428515e34bdd49c637a24f0792f56b1cf24c4e7efe9ff1fecc",
            "4036053d1f41aee34f670d952b69217c8ab7846884a890b1e83d51a7ebec0252", "9723136bed1b37e9a70c1198188006161d3135dec634ea6050cd22085aa1042f",
            "4e7f296565343f18ec0333d65b71e75a26b3e5cc834457d076f7b57ecb24929a", "5a5d4ad978e2675346490d6976cfd02bd58961e6820d97e97f963e6b2990c6b3",
            "e9809a959d6872db36eca125fc35dde5086eeafd9a19ffdc28e22bdecf922205", "c8c896e6237ecf0a7e7e5bc5534fdbb16830c71046879ea2b2fab51d2cc22cbf",
            "0787b051d094d61edf65f0187707df68f317c35cb98e4db7caf87a5d4442b844", "90ad9ebc76c2db25829ebe2497fb8c6554b4c1b11ada63e852b3feca381fb455",
            "505a392545b156c448cd9013c6fb7af0ef74617126540cd7244e2d50ee140aee", "c58a22e2ba402d9f5bcfa085cbb74775b1402b86797110852adb6e1adb8e54f0",
            "d40279e18ca6d3e72e624ecf2d92dd9453c5d5e99809755267a18f74bb16fbc8", "83aabbe7a37177e72ce0c337e3742efeab5aabbe06a4ec19362640b5a49bdcd2",
            "b596e61fb1ef384b55daf6cb7585d18884b51706da444ecc08aeb0c19ad08c22", "4a99542560e420d134b33fa4b71c26a91a9e31f4fe1713641933c6b10be6a14f",
            "bffbad0d5473219cd6e7d6b03cf23cc687bb4ea7494e1498323f6be1f95e3931", "5d90cf132c255b45e7f079eab55a7ce0a9be3d0bd5d47a3e10f72a44444d16bd",
            "24f2ebd7aab34e19e65156a09a2d8b194f7cd114e47f9419cfc2043f8ef6b8ea", "acc29d84983737aef6193e2bc0f272ec338a1b41e7f453df209ff078db177e3d",
            "3179fc4f9f6caa46fdec72b3f1f352185d81431c8caa473d281c2d8f4fbfd935", "327623fbd06861cddd9500866807e31a4effe57f5b64934383adab3157ba4ea5",
            "98921254b087152778bb3e8fb1c865bb0093dce5e9d2548c42c99cb6d1581acb", "a700c02424bcafa0a463f2b2648495dd5afc1737d8f23ec8c7f41a1b51f9ac69",
            "57ada9bd1ce567e4590340e08e5f81d9c492b64be2c3b23c8922409a92b16ad1", "4c3f0c3855f9e83b9cebb8776564f0d802c315219ba4f77f1101834cbcb3b75c",
            "23aac8385ddb1ddc96ae93ea8dc9ee93897249316e1e078aed43593d4b17fd8b", "8358608fea225d03e3edb1fcd2f5de37c4d8b93a09168cbccbc327c6e4b54b2c",
            "3c94d1e6a1aff484c9e9188091bf518b84e81a853c4882a640eca833e2ecdede", "89f1c89236bcfd32904d6b4e9e1b9cf3a0957e7cb30d7f422ec176d5d17374e1",
            "e14afa7c47e95e34bef07df2a41a22b33459e6967d976e200fca2ef25d06d58d", "a525092d6bd6c2616341cce7abed301b5937656589faf0fa1fb7257cb481b09f",
            "4ac5e4bab22b1ba9d60e9f4d09884f164b378ccfa98e3ba6de4ff42f8533b826", "65c1fffd77ea5abbd2b27b25a13c12b1ade3c0b6a249c57d58356b0a11664e62",
            "8752831a938e02c9e8442a6e38d1d4b057fa17fe0a90280c1521f0caa58fe702", "dcd6702a4efd4e4e1ad18a9f2ae89bdd684d515187d5480ec735e9b97657647e",
            "d1f8376f7d463f69530e9d10acab26d359dad8ec074a88096d26ccb341f1a3ab", "7baa0d94368b20b13b26d5159c473eb06ff6015c576af0be117eddbda1f9b3a5",
            "48a4d882922a119974529b7dd8d65586761edd96ab35666139086d0c7802222f",
        ],
    ],
    "LGPL-2.0": [
        [
            "d096b5b4197a10a6073389fa1f08a8ee1e0ce8ac1ba4b34a698d58a2d75e62ae", "07e74c009e009d0f22c5537dbc5d58b1d20bdd309b77d4c23ee02d6827fb30e0",
            "9a9b9a1c3f54a244a0f9fe66967769d25f166dcd6209e2c205ef50915e683bdc", "c52ed85fba3d5f9e611ba9758090c2cdaf044a4e6301460a363db23680b4a67c",
            "9b39b37569698508f1b75b1cc814dfaa3d53c1639825ff41e6b88db7b955a1e1", "b9f10dab996eae3d9199ad93dda312a3d8d7d43c2db83958ee4aafdd78f61be2",
            "f380dfc6d56253d8f37154d7bbdec47a91320231e5baacc011b6d9fc42b36858", "c8aed4b5af7a476fbde24c8ba252b26c28979b848cce9afdc14aacbfe196356f",
            "5fb582937f208d3373418a27660a7466d289b0b212a111a3b3f00fb103eb261c", "e72a4574b00fa8f4f72e4c7d3ffc2e836c39b97f12bfb6b71bfb31f86fc5de4e",
            "e759780161ddf548d63870a1f89ee13af9df306d16c99726488207f7222f368d", "0ba96305040a353cfa8cd8249d1a82954ea31410db1513c298041000fd3fd169",
            "df16be5d61be8f045d92a8c072a4cfe6634d2b3cacbce9b4d0c2fdab3ef6e219", "55737b258225fbb1e0f2ba2e60ebca5a39572aa0a1599b742b6e853b3bba4f3c",
            "5016ac9e798f8c8272bfadc3ee63355a6b37c98dc22f35b7078c408834efc78e", "39ac40ce3657fe702f06c86b03f4b4d3e60ef61ea96d8f502cb34758c713737e",
            "713062b3fc3139b29143c5bb514e2b05857751a1e0336ca18e74a44a3c945ca2", "29f2f9b62d6cc8352e229aec3418286b9b62d499de9407eeca7387b4f427e2fa",
            "1703bfbae577e29c08d2d266f268f2bc16b58312bf86567286f0dd703c0eafe7", "ed241ee0e0a4a48ce0019b131432c3808f219ac018f3fc5a88d4d97fe7a4b720",
            "7e4654534613475d4541194d423bdc16cd9734bab3b7baa6c30cacf0ef7b5192", "edd027ab1f7834469723ed514d28479143858d9a59e522aa50d96ac885740d20",
            "d593207510d43775a4e34999cc727b5c6d53f18a72bc1f8ff10e4738e6f2de4c", "b5a03743c4f8d89041c689663b43bc06caaf7a6441f8d3480cb51bbbe371b6d2",
            "270f41e760b986fdaa9dda5f5a87a621bd30667aa18787e226d76caf1e017c15", "a5c6969f1877bc0c9e2d202c3441c67e8a5976bf2921608bd53e7d7882ed37ed",
            "3d9c0010d97d625575975859099ecdc8369504364611936bc34311370053f975", "aedf03c14e2d23b5d6f207b285a1cfee484fab9a21ffd05cf2ff19e65a409c4a",
            "57de73381522a9cf977efb4950642f78321e6d8babacdd549a73d75babc1c403", "e36386486386b0d275e5f55e30ff616a69f9de92225994c1837f1675e813c032",
            "5e21974f98c720ee61fff375ddc15692c97771549ae6e3476a8d054e4b25109f", "255a5a068cc4280763121fabea747f409fff24d35f778c49bf489a970d19ef8e",
            "485cf69b3d75a28b990d081d08f5d1be7215e6140d96a3d5984f3c610288c10d", "645dc1834f709bbfeaa1c99b4e5178e2899909c53c2eba0fb4696ecd40409fb2",
            "2f6d11746fe6b257bf7a7c4d4904ad8da998121e93084de031f42c78d8b4e8c9", "8cffc61b738700f82d9ad41f961b214089fe08ce917a6cd5c39f4db847c5f142",
            "434bff3d80b2ae2ef03f12a6b0f4436007de8847985004a89fc11b89ca6c201e", "636d1a98fee11fadbee9a0746e8d8aa6361c3bb3853c75e4d971934e25c16d27",
            "05bccf7dd5fab15282fe249465cbb73549ba86b3efe7faf7143393a815b0a3cd", "651f7fd9ffac782a24f53cc18abefe763adc104a724e1376da4e82d9f5d99e1d",
            "3c276b26f93a42a757d4914c176ad952fa1df5ede7bb4e61a8ba6d9d2a64a311", "bd7a2f804d6df8bc47ae3500e1d12d668674707f30d002e111d88b446bebc1e4",
            "b4e6605c47c8158ea2418acdbf85afd81b96b000002cacc78673243f1868945f", "ce1af8e971cccca29fd0ee6c85d4affc97b6e81fabbc30a18810caa5ce69a391",
            "64ae52a6226f186d6a9dab73ed728e9df76d1dcd1509f6aebcedfae4119151d8", "12a2e33e6fad236c255ca7b5a4011808fac825b5be344bcc040965747b12e457",
            "933303b312f1a0626a1556da79b150235793608e563ba7e723016b51a1d9c17b", "4387b3a84b6b6f7915c6ee30a0f02a13b5134c389422aee554b4f3a51738b783",
            "886f2a656c203fe8e0e9aeaf780390ea37969fdf023e27ad495e3120d1d319ac", "7b23bfa22220c7a879267fd56b90e730cd598cc9873f8d886c1f946ea4e81717",
            "25850e381f9e944ef892eb4bd0bf67ee75e2a1759452107e03436feaf759afce", "a10cb78be5613d11160457dc71646ee811c5c8bf8006d68c1f531ba4e5a22342",
            "f3207b47b487e853abfca43d83ae4fe7af09efddab0dbfc566c547d2f05715ae", "b37d69ead60104eb364fbf3e98df6b55fe5a7811155828427afc1dbd37c59961",
            "1c7df6a7b7b0ab7404c8c4f6ee23d7da62c92f2a1fa87892bea27ce3263b4c8f", "72363341dba43e00cef645cf13f0ad007ada49c47d691c8c9b94d041569e3753",
            "9a4157c8c233704cdf90de004c19df98bec1fb7115b28e28c09c0a3063454879", "175fbc8b3c18882e2f6b1fc3f47c0360c4af3f221ff150c0df4d3f0b39b9faab",
            "5f948da1f3aee4c914e38c63bdd865e42ed584c41591abafc94b4cca5add969a", "bca0cb858ea41e06f7b2fbcd8f2986dcd4aa7d27c4309103538885b8ac9bead2",
            "5b40378b7726b95842868dc342c3b30eb6d283aa106d2ec38bb3fb89745a0af0", "ad4f20b3dbccf04bbc7477abcb1f638c68f898ef9abb312b6f6e247c20537fab",
            "e7bc631f142e338a1bca3480599d079932cd389ba0f8d16d4f9b695fcbbe5732", "38a9150239b9197c78e7c73b5a7a791ebe181a9af90a2dfa7e8e52ed85e28dbc",
            "711e6b8bdcaaa926cfa3b6125f6b42a8f6f6798981a26358f13d915cbb0302dc", "c43dfbfc98e82261cca55e0f23ef1f050e26d0c829a70e80ef1e1d02c19576cc",
            "6e76c4058edf07dc20283d6c13273f94c297d2f5acf6bd00d1cea99f486793af", "0668cd4435e307af7fea5dd3833e3052fedaeb549b9afb1a54b0778015bc63ac",
            "08d075679ff0963d137622c6ec2e74bd9935d52fb8321c26b972d108f21a834e", "95cef4f7d3c9c92dbd670ba7dd68c0df8b544ff47cec466cd23df760131c96bc",
            "93e69e44fa77c3153cafc539b81d7459da9351f881654b42ebcab835a8b63eb8", "6cf6fa34c8113bce9c9a5a9afc16d4cd4b5dee2699aa9277e89b2719aa72e1c2",
            "b3143badf03a3c8ec5637ec52198279304a61d088617f093f4d8e74eff48aad3",
        ],
    ],
    "LGPL-2.1": [
        [
            "d096b5b4197a10a6073389fa1f08a8ee1e0ce8ac1ba4b34a698d58a2d75e62ae", "175db8a265ef45a1dd62ba8bfa9565ee7bdf3b1ab4be97cd999444ae4619ef4e",
            "9a9b9a1c3f54a244a0f9fe66967769d25f166dcd6209e2c205ef50915e683bdc", "c52ed85fba3d5f9e611ba9758090c2cdaf044a4e6301460a363db23680b4a67c",
            "e2b6a347383794e027cd6ee487bb9b1cc4fc4fb33a944cba5e1c2abb1589c7ad", "042734f3502015bbb4c374d96a4b5ecadbd17e6c526d6b29417835563867b7df",
            "a559932796881da4666d7030dd550de2972876b224acc8afc020f85e7e748514", "bda22e706978307f738378f38e0728550bfaff0faaaa32ed0e5de5a0e9acc638",
            "a1aefb8e0be41ba72d69fafa019e96d29f7edd8331c6933e205bdaa0fcd65e23", "2541376e7e3a8d30263a100c4297214e2137649970dfb68af22b10fa47f37cd9",
            "b8b7599e59c002ba34efd8fea1754374cd08882067ef1a5be1b4cd5ca746fb2f", "abf5ce0ff69a649d7a792cb26abe2ea49fc3821e23e7fe8e964646ffed239840",
            "fb3e47ab94769a573a340606a5634d895b05b74481766d9821761e547f10b217", "9cc6e831f13a49d10c33f90031f1dee7722f0c674f73c2a8551dba17c1453997",
            "3402351ace442e104b3ac5fdccbc2eeea9eeaf71b369e8cd9005a3c4111c26de", "5259ec0f1ad2d2572d948abce72ee301345af39d41e5705c8205333434ed6ece",
            "0dadd0ca7a6ffebb98370d561b6e5e8a8419760cfb3956460d75ebc1952a7d31", "b0ab9b33fee6ee7855917f9a7fe2ccca7aceed01b27c3fc4bb84483feab445d7",
            "29f2f9b62d6cc8352e229aec3418286b9b62d499de9407eeca7387b4f427e2fa", "1703bfbae577e29c08d2d266f268f2bc16b58312bf86567286f0dd703c0eafe7",
            "ed241ee0e0a4a48ce0019b131432c3808f219ac018f3fc5a88d4d97fe7a4b720", "7e4654534613475d4541194d423bdc16cd9734bab3b7baa6c30cacf0ef7b5192",
            "edd027ab1f7834469723ed514d28479143858d9a59e522aa50d96ac885740d20", "d593207510d43775a4e34999cc727b5c6d53f18a72bc1f8ff10e4738e6f2de4c",
            "b5a03743c4f8d89041c689663b43bc06caaf7a6441f8d3480cb51bbbe371b6d2", "270f41e760b986fdaa9dda5f5a87a621bd30667aa18787e226d76caf1e017c15",
            "a5c6969f1877bc0c9e2d202c3441c67e8a5976bf2921608bd53e7d7882ed37ed", "3d9c0010d97d625575975859099ecdc8369504364611936bc34311370053f975",
            "aedf03c14e2d23b5d6f207b285a1cfee484fab9a21ffd05cf2ff19e65a409c4a", "57de73381522a9cf977efb4950642f78321e6d8babacdd549a73d75babc1c403",
            "e36386486386b0d275e5f55e30ff616a69f9de92225994c1837f1675e813c032", "5e21974f98c720ee61fff375ddc15692c97771549ae6e3476a8d054e4b25109f",
            "255a5a068cc4280763121fabea747f409fff24d35f778c49bf489a970d19ef8e", "485cf69b3d75a28b990d081d08f5d1be7215e6140d96a3d5984f3c610288c10d",
            "645dc1834f709bbfeaa1c99b4e5178e2899909c53c2eba0fb4696ecd40409fb2", "2f6d11746fe6b257bf7a7c4d4904ad8da998121e93084de031f42c78d8b4e8c9",
            "8cffc61b738700f82d9ad41f961b214089fe08ce917a6cd5c39f4db847c5f142", "434bff3d80b2ae2ef03f12a6b0f4436007de8847985004a89fc11b89ca6c201e",
            "636d1a98fee11fadbee9a0746e8d8aa6361c3bb3853c75e4d971934e25c16d27", "05bccf7dd5fab15282fe249465cbb73549ba86b3efe7faf7143393a815b0a3cd",
            "622aec874a492695c3546ab025155ccd92d88634df6157cdb185a6a9d5b54cb4", "3c276b26f93a42a757d4914c176ad952fa1df5ede7bb4e61a8ba6d9d2a64a311",
            "bd7a2f804d6df8bc47ae3500e1d12d668674707f30d002e111d88b446bebc1e4", "6353fefe0c7afa8073fb252b896ffcfa6f39b3a04d54495698d927b85b861e4f",
            "3d57786e94c9a5b344660c6aebdcbbaa362bd7003ea1980918872662c8e8f9be", "6be95ca584d5f3c9443e6e6db8d9a636c3dea4d2336ffc5b433b61f2b679172e",
            "17a697a5488dd693519513bc0beb535087567fd215e5b0c088ee0744ce336f06", "ac8bbba8588aae299285c60cbbafe02f64c772c44cdac2a6346b5e0dae025ab1",
            "933303b312f1a0626a1556da79b150235793608e563ba7e723016b51a1d9c17b", "4387b3a84b6b6f7915c6ee30a0f02a13b5134c389422aee554b4f3a51738b783",
            "886f2a656c203fe8e0e9aeaf780390ea37969fdf023e27ad495e3120d1d319ac", "7b23bfa22220c7a879267fd56b90e730cd598cc9873f8d886c1f946ea4e81717",
            "25850e381f9e944ef892eb4bd0bf67ee75e2a1759452107e03436feaf759afce", "f9090113301d8de7bb158b29f83b3fe11dd5904108cb5cd590dcdad00899401b",
            "f3207b47b487e853abfca43d83ae4fe7af09efddab0dbfc566c547d2f05715ae", "b37d69ead60104eb364fbf3e98df6b55fe5a7811155828427afc1dbd37c59961",
            "1c7df6a7b7b0ab7404c8c4f6ee23d7da62c92f2a1fa87892bea27ce3263b4c8f", "72363341dba43e00cef645cf13f0ad007ada49c47d691c8c9b94d041569e3753",
            "efe254f491203d3833b3070f8eab776b4b3e757ad0f71f00bfbc11567be40d7f", "175fbc8b3c18882e2f6b1fc3f47c0360c4af3f221ff150c0df4d3f0b39b9faab",
            "5f948da1f3aee4c914e38c63bdd865e42ed584c41591abafc94b4cca5add969a", "bca0cb858ea41e06f7b2fbcd8f2986dcd4aa7d27c4309103538885b8ac9bead2",
            "5b40378b7726b95842868dc342c3b30eb6d283aa106d2ec38bb3fb89745a0af0", "ad4f20b3dbccf04bbc7477abcb1f638c68f898ef9abb312b6f6e247c20537fab",
            "e7bc631f142e338a1bca3480599d079932cd389ba0f8d16d4f9b695fcbbe5732", "38a9150239b9197c78e7c73b5a7a791ebe181a9af90a2dfa7e8e52ed85e28dbc",
            "711e6b8bdcaaa926cfa3b6125f6b42a8f6f6798981a26358f13d915cbb0302dc", "3d43f3599cd8306a5e9c7255077f3c826a7543312eda4ecf9d50975abeb8e95f",
            "29ec30bf0b22bee9f2d303fb72e06a9824c52353301e2bdd31ab8de1b90fcba6", "4b5c9dc7aa76f30d2caa3ff63d7731f5b1b91612a20d0fbe63dd847d7839de1b",
            "08d075679ff0963d137622c6ec2e74bd9935d52fb8321c26b972d108f21a834e", "95cef4f7d3c9c92dbd670ba7dd68c0df8b544ff47cec466cd23df760131c96bc",
            "93e69e44fa77c3153cafc539b81d7459da9351f881654b42ebcab835a8b63eb8", "6cf6fa34c8113bce9c9a5a9afc16d4cd4b5dee2699aa9277e89b2719aa72e1c2",
            "b3143badf03a3c8ec5637ec52198279304a61d088617f093f4d8e74eff48aad3",
        ],
    ],
    "LGPL-3.0": [
        [
            "aaf9385eedc0e8797f25532c8f623c05bba02ebe7b124aefa1352367290a485a", "5970fa0659dc97cf56a24259b94b6db0baa62cdee47d661ea0f04eb6faf1f411",
            "7c381c3a725a12608a04939dfa0649dc4c48128dc6859fc496e3042b8ef00fec", "01c5eebbce6d60cf5fa61238a97ff9d97a446dd450233b583116aa0685191535",
            "671ebff08fefac21f28af4854f3b688b3dd7215d7fa63f3e5540d4695bca407b", "c818feae5c80c052f5d133313a3acf5092bb6fba69670fe832fb60abe71d7ef1",
            "74cdd819b81b1f0335db167ed9678869c58c1ceae94f12761c46fad324a1e086", "7ab37d4c63c5f3a767057927f7774e7679756e9d8068d51ae5b7e077162f53b7",
            "1ca2719c924a7f14fa5db77e2fe585af87dc9013fcc07e5e215d2edb38a1da10", "150d8adfe1c86247ff224a1df77b78ebf19424258f9b0a1c9ae4a7065e9d5b12",
            "064db1bbaf9e169d5f4bf6d1d02458b25345a5d14540a6bb9a0a7c1590c71898", "e4f6b3f1e49fb6241e3f42d1e82991365a1db4a0249ed7d4ec8e1959eccf7870",
            "59dd7d0706eec4cad66a293159fcda9e92e0243cb584533a3e8be2641986e375", "10e4a8df1fa179d76e4fd1d02c7718a7b8a4f203f12e1a757ce6fd55b3b39347",
            "d5aefdc989d93e28f7285a3353249a14caf882138b7174346f8a55101479ced4", "01877aaa187a6c6c473e1846d4afc1e38f75aae28640c2c0bac2d7a6a6acd8d6",
            "eb0ce365923cea370a3c53ce4a18f84f43bf7306d648e2e0c7418ebd9a0eb33d", "5e11e4ba8a3985b05e0c761d8531af8065649396a17b3587d0c8ff448fd5a8fa",
            "751b845af7e51e29bfbf53f4606095f5de0f7d78ad4d73594991a2ce5f956879", "52298baee596396ce086a742623b165d88b53624272b7243a755ed48452226dc",
            "9763f852c13d94ff5c72b49fb31824bba6dd08d2de2a7c1a07490350a05de2fc", "7e1396f1f76dca5abb42d46c70e8a6c2ce4d6d85ad5af4ffa78a312d25a951e8",
            "c8eeb0a2aca6f4480b7d68eaf091f8fdbd9ca06df0a6343af0ab3f618f61d708", "e78ae662b52b0c4a8a28058322a808e361eb57867671aea766af4747726baa99",
            "3e3be73a4b0f3888c22aef1d521ceec4b3f3967a16cefd6f06a0a04c329a5473", "cfcca956e2b61d87d89680e3444211a808dc0142b398a915e066151deab7c5dd",
            "5eef5ea3f95d46e0561a7ad629a7dad626ac2609f4a7592513376543d290ce4a", "fcb2de215b897525993e7fb40a42291145dcfe8ec6e9dd2dca83770b5e5f8058",
            "a71246f2f16d027f25f9e3acc801bf41af15d9f486646408fbd99e0ada65e7bc", "b52c3ae7fb4ccd543a24b4906ffed682e9816f3dfaabb33a2199c7a60fe4a0f9",
            "bd42dad5c30b835bd32827a6d6566878db3f4be90dc6d7995aa184425ccf6919", "f44418ffc4071a8b1eb4860f1dceb45ba5ccdad495cee62e11cedb391dbb646b",
            "8ab76054087ba61686a54e100f52291c21e8f81f60c7c65577d1ed7f8ddbf860", "c5cd7709e49348df3949b0c9cb5d172ee5ae35bf1ddaa3acbd94177b88decdc3",
            "dd152927268782bda642d42005e7139bc2dfb67f539f2638743668ff7bb02da0", "fb31a8ea93295b990e0669f85c85de3df32d3dc6e6a1c320310093d606ba9366",
        ],
    ],
    "MPL-1.1": [
        [
            "784dea8d8b9daeeeba5cd79b5d96e1fd6d280392c4f8e862fb0805055629bc8e", "618e3c9e356b945714ad63d2c2110eb05cb19f08b11ca47dab3b2cc59916c47b",
            "5506b6ffaafd861be6474567fbbfab5e9dda7990e9cc315f5fc89d1e0417df7e", "c555d9756875f42b647f57760cf9844f1f85aef39cdf3b32211d3e916fefe152",
            "a83be976bb8ebf473ce18d8da0bb27bd0e82f1bbd3e80fd078cda68985e6904b", "70c8f00061a8322853389e5f0c5651e90da47532d6a4629f81047b8ba15b19ac",
            "a0db69e0debddb9b48c9c0321ea2a98b291f5487a8c86c7d66ea474f84e74d54", "d17c5832bf719ce60a11a86f14b35b4365a2db779641095f268f8c53cbbf5cb9",
            "b11defba38fb955434c1dd26cf88ece903baabc7c0548a27761d9af9a3d2e515", "caa317a10b906f38adef372b56458e83e0e28b296d1fb5839230b4647c252dfb",
            "549e880914ad177a0692347be826ca8fe05bff626ca915575d47e307b8018ea0", "92ec58b2c60eb8b233f36ba851b3911ce227f421eaf718cc7f819734e4b0ed12",
            "5cfb87db5d0e82bbf0bcc2c5ecf6c2af8f61ad1265565df4fb6cc811af686a91", "68b12b150fead6a4b41e216fc26671947c44033eb000773ef60ffbffbd70a383",
            "1c382a05abaee5251cc5bcb3c94d3f18c50d9f5108f98c3342936abbf9d2cec8", "fd1487e6e22805863752fde7a244b3d0133202e6c8bb308f31c2f0a15aee1172",
            "4cb1bc9a1690cefc70cc6bf3b79b11be84b29f7745c8c9681c7ddbc11ea22cd3", "4d3226e39b1ee881d782c95f20f919432cf8b59d181729deb1414aa3410a733b",
            "0658c2074d60a42481da4ab563613b7d6e65df73c783ed31b28277c842a2fb57", "fa7712d6f89f80c446fa3f94cef1633aeb6431bea368e54113329ba8661fc603",
            "bff9b417bdba878dbe0a4d9fa966f64c3a61887b21be8f67f362e320f788af86", "b15c522cf4da11b4ade4479c760f594ab6d0f685abfba60337d952ebc80e5b32",
            "b74e38dce60c6ae18cdc410ed58910123c9a7e1265bcb8c5f75bff1f4559ddfe", "d77cea491aebf6909c4cc22f527477bdacdcfc3f1030cefe2de198c83465c5e2",
            "e0d8e5a528bbb515808ccc7dc7196f36a59a8ca7a9cde97f3901710b412bae81", "a55a7c5db3b778a525a4a9f780a1207d035fbee086e52dbd3b5634b17c5d54e8",
            "220196a52c16b030b3bcd67673a723eb4da626aaaf8d416bc04be72dd3808230", "067885076c8a654385d3395d23680e1473eb3dfda273e23c25f750cf03c18441",
            "2ce9481b0bb5c4e6217977ae699f8df65e0623992891c9fdf53464748f718787", "90b4b749b076c142a962d40cef7cb4f781795e53fa8cd5e67de270f53787db85",
            "cda48627661d080f4e28f5d1242db9e42c44b253509142604be95409299ab8bd", "08dafd61a0090295e18b97f21b826bdeaa925c6775a9db1523277d72283346b0",
            "390217f7298a3ebac7793f28401636e9055f7f4f00534b0e044ce3d7f82f7aa3", "941e37c93ccbe41c63176cfaf4d58397aca34a30be32a58f50051cc08e67b581",
            "dd466a2dd9e5ede668cce9c142b3fcf9410702f7a8bdebeb152264b15144952f", "21323d5f93a8603e12dc77bc4dff97f95cbe40c6e6446985c4bd399b1d1ca79a",
            "21a428cf27b6193aa098411f4105daffb9c214b40c2a5b922f2e7d8dc3c220e8", "28c8492c6558524812b9ce2b362036dd869bb78f71e02763b14fd3bbe361f6a1",
            "daeba77372bbdbd65a34dafadd38c20d48bc652b1346feb7c65541f79ef5e509", "c0f776ff6d46055e23ff05a3119605ac4fdfc587d3c1f64da918128d959ab57d",
            "dfdf88b6d074ae4f11399efdf8a686b7daab8631e34ea64e6de01fb509c363c4", "816aaf7ac0cad872d3f6067cc8f86503440b4fc03e243bd3e20878e449a3d580",
            "ecbd28fad7c006fe8465acecaf2aa3f5f8da56abf18574c5d4c290276dc73906", "e274b19df20ea43572c2a93536f4f0fc8578243e370b1550c933fd9c0c7f8221",
            "2dc9c6b1a99871129333bb40f63605d989b88ded90c7341bdd801235c33156d4", "1f8291b98743534777d0ec47ef69e890f88d98b17fe5d3d2046a9b1e88ae8ea6",
            "4e7f296565343f18ec0333d65b71e75a26b3e5cc834457d076f7b57ecb24929a", "b834c67d58a2858afebb72b03e1f3b80d03bac18d9823743efc3fe97d7ca5ecb",
            "c5ccb77f8b4c152c1d4848b7fc233e54da4c5e7f016238986ab7f2b9e6d3e257", "2b1cd3c7f6b88e66f1b9cb05667505561b3ce903cfb2c2d5284a3ab9e45b1ad4",
            "09914ade7aceb413b180f8f4b8b6c4d89832a0913b41f3b2abb6274653824f90", "c9a03cbeb33a65bda3d9e9978f009568af42f02338ee4622e32f69a687369acf",
            "0d148a33e9d4b06d8a5e0d6bf8726aec2235a52ec9e460c0e4708ce899196278", "c13ab2a47b052077fed07131395169511ad589c62c2721e47a434e60cb49cf8d",
            "04cbfb77fcba3c3caa131ba2c3f40b66948fde18e0ed64ae72b4c48420434d2e", "794fd5eb1c2ca7c9bc587364e66fab5f0fece4051a290be588a40b80f1eb8f9b",
            "7e5865bd09b77f8111c296cb980e109879a6e9a4b5f4903651fe988c6a5fba97", "cb1343657908fdd008c30532630a3861af6c2b5c24444ecdd15fa9e826ba4049",
            "42498ceb64f2e4fc1d8a7f145f4419a28340cf8acb694b0a184a09d5a3037080", "cad76e323a36469fd9e57f08ade6a628ddc2f3a8dbb8c32734198147e349c909",
            "743f958295e7a4736f48b071e1107e170bfdc3fc40ba732dcb3759e4a443e6cb", "668a320b3a0904528e206a818440ba0abd2ce0c7e02d352e3626fa64dcf40739",
            "f640e6314a3d75e4fc6d382bd68371d457f10f8e9b34660e709c92731c58bc4d", "56b924e57290be6913b837aef9b40b4361434345df350fc8766a34843426a5eb",
            "2b1690cf3767615f8c85001a4bee9223375a504a99ff71952fb99f293067ab9b", "3d31d9444dc03408ed458350aed4e15e992f9f0e44351ced6dd82728ae8de191",
            "52b9b9b0cd2eb7ae932e72a36506acd299b6aae0e6c5a8b099c9d2068cf88884", "314e83ae5b4703d8381f1a943c7c0f135eaeb2b1ded527d91b80f2f9b5efedbe",
            "a23e17a2b1aa1ead39208707995f4a8e0ff392a1c4db28a6c281ddce40b2f52e", "fef9a27180aedee977e1d587b70a6998967c3da4bdde53acdfb3c39e05092c10",
            "b0dc50976a6d7e1e3ed1c08b47cb0de77906755978c35089c0166fbc377d0ec6",
        ],
    ],
    "MPL-2.0": [
        [
            "7b42c8b5b9d1c573949495225fa2e38cd985eb24c3932e211637a65093b2db7a", "f014d570487ba4346b67a1f85051209835ae63ff0cebd120c94c3d8ad7abd479",
            "20c69f56f0dadf10ae9284771797b361bb450fa8692e0232537eae3c9afa5739", "a8751b95e00087126abc5fced2428e72358bc3a694dcec3c57d7c18144024b22",
            "206a6eeb809cb4479fb320cd0e9f98f58fac848292c18137845338e3a8692328", "8f65e5dbd070eac929367d3089734342b03a00b7a6e329c6e74a7d97c84874f0",
            "4b3d853a18d78fc601eae2a1580c018ea938a92b705dd2c87bf4edf235d2dd68", "9c452d40de639a5ecead8100e34db38b1579668b175938c45d258666a5963393",
            "80174f8aae33caabf3376bfb8368b010c0e1963f9d94d7ba0914a2694f03c7bd", "b11defba38fb955434c1dd26cf88ece903baabc7c0548a27761d9af9a3d2e515",
            "cc8da02c772e29d8ecf0138324f67d5c77aa06278b00a193bb1f064f4deb9c76", "d55bcaa726c3bb3f4325d5b387917d4138e51eb31e16eaed0af0e06cc228262e",
            "1971f834cdb3ecf162a2dfa9fb8d0a70e59de40febe58d675fa5f1a477be6a6e", "9cfd6507a1093c7235580f4c4fc8fef5703f9d45df944307ca287fc27c7e6550",
            "6e172c0cc78347962ddcc2b8caec9a3b7bb5351b6fae5b196b6646928c41dbe4", "6b535afd7063624f1ab98668a4fefa79a180058b053155322595e56025ac5e22",
            "2069e4b053691522805a12f5080af83863ab5e826d2b530be16bbf9b335180c7", "4f26bea4b89e173d146115dda87694ce645425d672d04b2a6fb986132e5cb53b",
            "3f0889ed22d558249007dc260aa8eff200876929b17a00db1b7d2f8364eae28e", "9ead65c0ea11ba33c3944ce70b95d0f6826f47a7d5e13b812738b64e201a90bf",
            "bdd42de1c9cb2cec120d10b6bc4d8ad21e47a5faa4771a666b7cb8ca8005f3df", "104fe6d9b7e0b3cdb15ba7db490b30a4cff0f63943797e45d90ecc16e572367a",
            "418960bc8a1e120a59d2e000fa212ab0c85af7ec021403e2cd5116de755caca7", "e258d415c9b0ee22522eaf9cb1c85e303c72024042498b600b130498a9a3079a",
            "e1e15cad535d9f8ed24ff0317d720cd4933c095c3b19698748e2118075c5d9bc", "1273d50d9648f2ee371e48239d51841554d91841d81cd16e3c1ccb54c32570c8",
            "c64ca04a86861493965414cb1c27cbb85c0e9c4d91fbea84cc38e0e5e88926e1", "749daccd49e8ff835bc1d9acc654d26da94e2c7888a1606c6ec84498d5f729eb",
            "043a6c4738b83deac4883154be7fc7ce6599324f059584be2c9b535f1e19d4fd", "7e6595ad7f588e9ff45629d75dc8127203ac67521c667be03715b41e183165db",
            "db06d2e3ad193fbc2d63a8202346b36cf7c2533b6b78f1dd29c944d0a33dad86", "68b11434f4834379e8c8ded7b6a0d2a31b90fa83cb2bba2d2a7015fa22d276f0",
            "fd8bf500616ff99ba3a535cd6c575dbd179d24d56526ddb775e94e45ef3f36ba", "5e2c2aa6ffe091581037bce351afae203b648db69895762a1fe0d715bb52df5c",
            "d4b4ae65ca68cc2efe93045b8ffb77c3b9b9f7194585575370747b2e1c36ad05", "c7427dbcc411bba8f445320f5f055c4a7f8f039983d305a980875427dc72268d",
            "d5ac3fc193be61e9771f81129798267bcce99962b2c7f03575930c91ac2927bf", "fd81f9b42e925fa529b6560f8765718a9bac60db6aeca1c3ba29ff90e916adc1",
            "58439a537e12a6353d08b616adce46b39d4ee1094dbd31773ba6c231eb8d6076", "aea33a373b802cb5eaf007db6ca884363558b39f9e8bd8371c03f58030c29ed0",
            "c998dea6bccc5a11147fa7df887546cae3769addaf0f66ff5acf1f3fd4af94ed", "c05cc3ad5a39edae52d84b7bdac386245196d84d4931e63de8f1506a988b77d8",
            "4e94008c5b2c38aaf6662660cf34088caab06d616a9b5050f806dac5f82cd45a", "799682e3ebe69aca86857ca057656a07792fa1a4b56e037d985ffd7801039fc4",
            "192cd0dec764b254362eb3c4d2704f865660d81635718a7982964fc7d728ad1e", "4384b35512a1b25f0d17752b2a2adf5063706ed16f64d1620668b056988af44d",
            "91d15e1cb2164b58386babe2cf6ef280aed6dcf3ce0e2f1efb8adfbb70118367", "d794c2d416bc2ab3161d32ae1c6a9c3b7572c35a6f291dbefdb16c96ae1e19a8",
            "495bf8454810af799e628e0307dffbaec9ef9d43fd47f1acb8ba524547d29312", "5f139a4892ce1d9ebec9505783570a34dcea876b35a140d7809f24c9d8c29341",
            "35da3b0833da2e56d50755767cf677d95aadcfcb945ad0d55f61f7bdce03bd21", "11ab4afe25ec76ce87dd8c738592d2d8667b9e62f1262f15e17cdf7eaf60d59a",
            "21a428cf27b6193aa098411f4105daffb9c214b40c2a5b922f2e7d8dc3c220e8", "b0b5adcba8c68c6d33ffe03bd3be4930d5e209700d1f04c524ee8f72c6ebac2b",
            "86a94b220881fb6de5ee91a6ad58af6f0398831e75c168567c86ebb7cb052a79", "f7a1b562445b4ac915a48d996299fdb1491512de7c7b6c7cbf4b35415f72e372",
            "2744fc433cef54f785cad43036792812b782d735481e5c2ef47e50a1b6570493", "98364e493d46403ef9ed3e1ddebe29837875a4b07149de3c1aef0af0b760d928",
            "b703bfd5d6d558cbb989f7f5dd63d60a1536940e10455f1e38e41ad3be72e29f", "cdf42e1bfc8919e9c705e7c16eed64a506a6080016d6e9377a8559c728a6efb1",
            "334cb8531cd6729e4f59c2cc3f6c8cc1f1169fa2054c7d33c698bbf255cb0041", "c2653effbeec6e8c5a3dcd51719adbca28773d25f4e481adfa7554b42d91c680",
            "a7896f645dd926027dba99b9276b819fcc0b2fe44d5a062a10b783fc00fb1632", "2a82dcf2744321bc9352465d71fe4bfbdbd25a73fc4d10bf94c56b19f46f3aab",
            "bf37086512af4427dc36a691f2aeeb43a845063e09591a4f1bb64d6e80eb5d0b", "c0973bb80dc0d7b340aec8baf2a22fd3aae1efe6407579c63b412ca2d2327517",
            "860898d75d073ebde23a1081677e340dd94b24ab9465721f018f73c921454489", "41f853316845c771e7c187cc227976caf616fa04be8b6739ba9c183dfd7ed165",
            "640a9cc165bd0ccf699a332dce068e02a296ddedf88c47d69be3acfef30fd95e", "0f9de007dfaebc175960bd81c05652e41f87adc60773b395a37be71bebde21a5",
            "2b22b24db09f15d0e0bb76dc5e22578f004e8b1f4b332f944725af65409d4776", "36ffb0ce5664cfb85afd3d9ee6d2a1e0f329e8e55e361299b20b11ca746377a5",
            "8ef0efca03049b80fc37f6a61d17ec8965dfddc4376fca98a2d9c44363436648", "91e64be38e924303427cb9de1b02fa0a80cdada5c1498a1a0441dc765dc7a39e",
            "acb0bece3dc447740b87a4db23e0d425157552e4a33f273241a94444c2368900", "7997a07e22bbab736bdf9a38b53baf2c2366519f3f85b8554c6ed2990bcc7379",
            "e6c04477a1160187e0b325085f2d6b72bd47c89e850e108f6be15b5911a80ce9", "099e76f836215c709702bf0a34f390082c65294f8bcf364df79e0dec63bf77e8",
            "d2a182e4e66cead514296eb8e71c8794069268b94eaf15b517aa6d69370c3166",
        ],
    ],
}
