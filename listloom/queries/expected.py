"""What the SQL counterparts expect of fixed values: literals of their own, apart from the package's."""

# Korean shop name, official shop name.
EXPECTED_ALIASES = [
    ("자포스", "Zappos"),
    ("휠라", "Fila"),
    ("반스", "Vans"),
    ("라코스테", "Lacoste"),
    ("아디다스", "Adidas"),
    ("크록스", "Crocs"),
    ("노스페이스", "North Face"),
    ("노스페이스 코리아", "North Face Korea"),
    ("노스페이스 영원", "North Face Youngone"),
    ("콜롬비아", "Columbia"),
    ("살로몬", "Salomon"),
    ("아식스", "Asics"),
    ("호카", "Hoka"),
    ("퓨마", "Puma"),
    ("에이비씨 그랜드 스테이지", "Abc Grand Stage"),
    ("리복", "Reebok"),
    ("타미힐피거", "Tommy Hilfiger"),
    ("락포트", "Rockport"),
    ("캘빈클라인", "Calvin Klein"),
    ("게스", "Guess"),
    ("랄프로렌", "Ralph Lauren"),
    ("파타고니아", "Patagonia"),
    ("메이시스", "Macys"),
    ("갭", "Gap"),
    ("갭팩토리", "Gap Factory"),
    ("게스팩토리", "Guess Factory"),
    ("스케쳐스", "Skechers"),
    ("클락스", "Clarks"),
    ("팀버랜드", "Timberland"),
    ("리바이스", "Levis"),
    ("챔피온", "Champion"),
    ("케즈", "Keds"),
    ("알도", "Aldo"),
    ("뉴발란스", "New Balance"),
    ("하바이아나스", "Havaianas"),
    ("테바", "Teva"),
    ("무스조", "Moose Jaw"),
    ("룰루레몬", "Lululemon"),
    ("마시모두띠", "Massimo Dutti"),
    ("카터스", "Carters"),
    ("센스", "Ssense"),
    ("미니로디니", "Mini Rodini"),
    ("피엘라벤", "Fjallraven"),
    ("나이키", "Nike"),
]

# Official shop name, host.
EXPECTED_HOSTS = [
    ("Zappos", "https://www.zappos.com"),
    ("Fila", "https://www.fila.com"),
    ("Vans", "https://www.vans.com"),
    ("Lacoste", "https://www.lacoste.com"),
    ("Adidas", "https://www.adidas.com"),
    ("Crocs", "https://www.crocs.com"),
    ("North Face", "https://www.thenorthface.com"),
    ("North Face Korea", "https://www.thenorthfacekorea.co.kr"),
    ("North Face Youngone", "https://www.youngonestore.co.kr"),
    ("Columbia", "https://www.columbia.com"),
    ("Salomon", "https://www.salomon.com"),
    ("Asics", "https://www.asics.com"),
    ("Hoka", "https://www.hoka.com"),
    ("Puma", "https://us.puma.com"),
    ("Abc Grand Stage", "https://grandstage.a-rt.com"),
    ("Reebok", "https://www.reebok.com"),
    ("Tommy Hilfiger", "https://usa.tommy.com"),
    ("Rockport", "https://www.rockport.com"),
    ("Calvin Klein", "https://www.calvinklein.usr"),
    ("Guess", "https://www.guess.com"),
    ("Ralph Lauren", "https://www.ralphlauren.com"),
    ("Patagonia", "https://www.patagonia.com"),
    ("Macys", "https://www.macys.com"),
    ("Gap", "https://www.gap.com"),
    ("Gap Factory", "https://www.gapfactory.com"),
    ("Guess Factory", "https://www.guessfactory.com"),
    ("Skechers", "https://www.skechers.com"),
    ("Clarks", "https://www.clarks.com"),
    ("Timberland", "https://www.timberland.com"),
    ("Levis", "https://www.levi.com"),
    ("Champion", "https://www.champion.com"),
    ("Keds", "https://www.keds.com"),
    ("Aldo", "https://www.aldoshoes.com"),
    ("New Balance", "https://www.newbalance.com"),
    ("Havaianas", "https://havaianas.com"),
    ("Teva", "https://www.teva.com"),
    ("Moose Jaw", "https://www.moosejaw.com"),
    ("Lululemon", "https://shop.lululemon.com"),
    ("Massimo Dutti", "https://www.massimodutti.com"),
    ("Carters", "https://www.carters.com"),
    ("Ssense", "https://www.ssense.com"),
    ("Mini Rodini", "https://www.minirodini.com"),
    ("Fjallraven", "https://www.fjallraven.com"),
    ("Nike", ""),
]

# Size group, size as text, size as number, foot length in mm.
EXPECTED_SIZES = [
    ("mens", "3.5", 3.5, 215),
    ("mens", "4", 4.0, 220),
    ("mens", "4.5", 4.5, 225),
    ("mens", "5", 5.0, 230),
    ("mens", "5.5", 5.5, 235),
    ("mens", "6", 6.0, 240),
    ("mens", "6.5", 6.5, 245),
    ("mens", "7", 7.0, 250),
    ("mens", "7.5", 7.5, 255),
    ("mens", "8", 8.0, 260),
    ("mens", "8.5", 8.5, 265),
    ("mens", "9", 9.0, 270),
    ("mens", "9.5", 9.5, 275),
    ("mens", "10", 10.0, 280),
    ("mens", "10.5", 10.5, 285),
    ("mens", "11", 11.0, 290),
    ("mens", "11.5", 11.5, 295),
    ("mens", "12", 12.0, 300),
    ("mens", "12.5", 12.5, 305),
    ("mens", "13", 13.0, 310),
    ("mens", "13.5", 13.5, 315),
    ("mens", "14", 14.0, 320),
    ("mens", "15", 15.0, 330),
    ("womens", "5", 5.0, 220),
    ("womens", "5.5", 5.5, 225),
    ("womens", "6", 6.0, 230),
    ("womens", "6.5", 6.5, 235),
    ("womens", "7", 7.0, 240),
    ("womens", "7.5", 7.5, 245),
    ("womens", "8", 8.0, 250),
    ("womens", "8.5", 8.5, 255),
    ("womens", "9", 9.0, 260),
    ("womens", "9.5", 9.5, 265),
    ("womens", "10", 10.0, 270),
    ("womens", "10.5", 10.5, 275),
    ("womens", "11", 11.0, 280),
    ("womens", "11.5", 11.5, 285),
    ("womens", "12", 12.0, 290),
    ("womens", "12.5", 12.5, 295),
    ("womens", "13", 13.0, 300),
    ("womens", "13.5", 13.5, 305),
    ("womens", "14", 14.0, 310),
    ("womens", "15", 15.0, 320),
    ("womens", "16", 16.0, 330),
    ("kids", "7", 7.0, 130),
    ("kids", "7.5", 7.5, 135),
    ("kids", "8", 8.0, 140),
    ("kids", "8.5", 8.5, 145),
    ("kids", "9", 9.0, 150),
    ("kids", "9.5", 9.5, 155),
    ("kids", "10", 10.0, 160),
    ("kids", "10.5", 10.5, 165),
    ("kids", "11", 11.0, 170),
    ("kids", "11.5", 11.5, 175),
    ("kids", "12", 12.0, 180),
    ("kids", "12.5", 12.5, 185),
    ("kids", "13", 13.0, 190),
    ("kids", "13.5", 13.5, 195),
    ("kids", "1", 1.0, 200),
    ("kids", "1.5", 1.5, 205),
    ("kids", "2", 2.0, 210),
    ("kids", "2.5", 2.5, 215),
    ("kids", "3", 3.0, 220),
    ("kids", "3.5", 3.5, 225),
    ("kids", "4", 4.0, 230),
    ("kids", "4.5", 4.5, 235),
    ("kids", "5", 5.0, 240),
    ("kids", "5.5", 5.5, 245),
    ("kids", "6", 6.0, 250),
    ("kids_with_k", "7K", 7.0, 130),
    ("kids_with_k", "7.5K", 7.5, 135),
    ("kids_with_k", "8K", 8.0, 140),
    ("kids_with_k", "8.5K", 8.5, 145),
    ("kids_with_k", "9K", 9.0, 150),
    ("kids_with_k", "9.5K", 9.5, 155),
    ("kids_with_k", "10K", 10.0, 160),
    ("kids_with_k", "10.5K", 10.5, 165),
    ("kids_with_k", "11K", 11.0, 170),
    ("kids_with_k", "11.5K", 11.5, 175),
    ("kids_with_k", "12K", 12.0, 180),
    ("kids_with_k", "12.5K", 12.5, 185),
    ("kids_with_k", "13K", 13.0, 190),
    ("kids_with_k", "13.5K", 13.5, 195),
    ("kids_with_k", "1", 1.0, 200),
    ("kids_with_k", "1.5", 1.5, 205),
    ("kids_with_k", "2", 2.0, 210),
    ("kids_with_k", "2.5", 2.5, 215),
    ("kids_with_k", "3", 3.0, 220),
    ("kids_with_k", "3.5", 3.5, 225),
    ("kids_with_k", "4", 4.0, 230),
    ("kids_with_k", "4.5", 4.5, 235),
    ("kids_with_k", "5", 5.0, 240),
    ("kids_with_k", "5.5", 5.5, 245),
    ("kids_with_k", "6", 6.0, 250),
    ("kids_with_front_k", "K7", 7.0, 130),
    ("kids_with_front_k", "K7.5", 7.5, 135),
    ("kids_with_front_k", "K8", 8.0, 140),
    ("kids_with_front_k", "K8.5", 8.5, 145),
    ("kids_with_front_k", "K9", 9.0, 150),
    ("kids_with_front_k", "K9.5", 9.5, 155),
    ("kids_with_front_k", "K10", 10.0, 160),
    ("kids_with_front_k", "K10.5", 10.5, 165),
    ("kids_with_front_k", "K11", 11.0, 170),
    ("kids_with_front_k", "K11.5", 11.5, 175),
    ("kids_with_front_k", "K12", 12.0, 180),
    ("kids_with_front_k", "K12.5", 12.5, 185),
    ("kids_with_front_k", "K13", 13.0, 190),
    ("kids_with_front_k", "K13.5", 13.5, 195),
    ("kids_with_front_k", "1", 1.0, 200),
    ("kids_with_front_k", "1.5", 1.5, 205),
    ("kids_with_front_k", "2", 2.0, 210),
    ("kids_with_front_k", "2.5", 2.5, 215),
    ("kids_with_front_k", "3", 3.0, 220),
    ("kids_with_front_k", "3.5", 3.5, 225),
    ("kids_with_front_k", "4", 4.0, 230),
    ("kids_with_front_k", "4.5", 4.5, 235),
    ("kids_with_front_k", "5", 5.0, 240),
    ("kids_with_front_k", "5.5", 5.5, 245),
    ("kids_with_front_k", "6", 6.0, 250),
    ("kids_complete", "1.0K", 1.0, 70),
    ("kids_complete", "2.0K", 2.0, 80),
    ("kids_complete", "3.0K", 3.0, 90),
    ("kids_complete", "4.0K", 4.0, 100),
    ("kids_complete", "5.0K", 5.0, 110),
    ("kids_complete", "5.5K", 5.5, 115),
    ("kids_complete", "6.0K", 6.0, 120),
    ("kids_complete", "6.5K", 6.5, 125),
    ("kids_complete", "7.0K", 7.0, 130),
    ("kids_complete", "7.5K", 7.5, 135),
    ("kids_complete", "8.0K", 8.0, 140),
    ("kids_complete", "8.5K", 8.5, 145),
    ("kids_complete", "9.0K", 9.0, 150),
    ("kids_complete", "9.5K", 9.5, 155),
    ("kids_complete", "10.0K", 10.0, 160),
    ("kids_complete", "10.5K", 10.5, 165),
    ("kids_complete", "11.0K", 11.0, 170),
    ("kids_complete", "11.5K", 11.5, 175),
    ("kids_complete", "12.0K", 12.0, 180),
    ("kids_complete", "12.5K", 12.5, 185),
    ("kids_complete", "13.0K", 13.0, 190),
    ("kids_complete", "13.5K", 13.5, 195),
    ("kids_complete", "1.0", 1.0, 200),
    ("kids_complete", "1.5", 1.5, 205),
    ("kids_complete", "2.0", 2.0, 210),
    ("kids_complete", "2.5", 2.5, 215),
    ("kids_complete", "3.0", 3.0, 220),
    ("kids_complete", "3.5", 3.5, 225),
    ("kids_complete", "4.0", 4.0, 230),
    ("kids_complete", "4.5", 4.5, 235),
    ("kids_complete", "5.0", 5.0, 240),
    ("kids_complete", "5.5", 5.5, 245),
    ("kids_complete", "6.0", 6.0, 250),
    ("kids_complete", "6.5", 6.5, 255),
    ("kids_complete", "7.0", 7.0, 260),
]
