"""Fixed values of the campaign report: names, units, labels and texts."""

# Column, kind, label, unit, other headers.
COLUMNS = (
    ("kampanya_id", "text", "Kampanya Kodu", "sayi", "campaign_id"),
    ("kampanya_adi", "text", "Kampanya", "sayi", "campaign_name"),
    ("platform", "text", "Platform", "sayi"),
    ("urun_kategorisi", "text", "Ürün Kategorisi", "sayi", "kategori"),
    ("donem", "period", "Dönem", "sayi", "period", "ay"),
    ("harcama_tl", "decimal", "Harcama", "TL", "harcama", "spend"),
    ("gosterim", "decimal", "Gösterim", "adet", "impressions"),
    ("tiklama", "decimal", "Tıklama", "adet", "clicks"),
    ("frekans", "decimal", "Frekans", "oran", "frequency"),
    ("donusum", "decimal", "Dönüşüm", "adet", "conversions", "donusumler"),
    ("gelir_tl", "decimal", "Gelir", "TL", "gelir", "revenue"),
)

# Series column -> (label, unit).
METRICS = {
    "roas": ("ROAS", "oran"),
    "net_kar_tl": ("Net Katkı", "TL"),
    "ctr": ("Tıklama Oranı", "%"),
    "cpc": ("Tıklama Başı Maliyet", "TL"),
    "cpm": ("Bin Gösterim Maliyeti", "TL"),
    "cpa": ("Dönüşüm Başı Maliyet", "TL"),
    "cvr": ("Dönüşüm Oranı", "%"),
    "roas_mom_yuzde": ("ROAS Değişimi (Aylık)", "%"),
    "harcama_mom_yuzde": ("Harcama Değişimi (Aylık)", "%"),
    "tiklama_mom_yuzde": ("Tıklama Değişimi (Aylık)", "%"),
    "frekans_delta": ("Frekans Değişimi", "oran"),
    "roas_ort3": ("ROAS (3 Dönem Ort.)", "oran"),
}

# Period total -> (label, unit).
PERIOD_AGGREGATES = {
    "toplam_harcama_tl": ("Toplam Harcama", "TL"),
    "toplam_gelir_tl": ("Toplam Gelir", "TL"),
    "portfoy_roas": ("Portföy ROAS", "oran"),
    "net_katki_tl": ("Net Katkı", "TL"),
    "zarardaki_kampanya": ("Zarardaki Kampanya", "sayi"),
    "toplam_donusum": ("Toplam Dönüşüm", "adet"),
    "toplam_tiklama": ("Toplam Tıklama", "adet"),
    "toplam_gosterim": ("Toplam Gösterim", "adet"),
    "ortalama_frekans": ("Ortalama Frekans", "oran"),
}

# Entity column -> (label, unit).
ENTITY_AGGREGATES = {
    "toplam_harcama_tl": ("Toplam Harcama", "TL"),
    "toplam_gelir_tl": ("Toplam Gelir", "TL"),
    "toplam_donusum": ("Toplam Dönüşüm", "adet"),
    "toplam_roas": ("Dönem Geneli ROAS", "oran"),
    "son_roas": ("Son ROAS", "oran"),
    "ilk_roas": ("İlk ROAS", "oran"),
    "roas_degisim_yuzde": ("ROAS Değişimi", "%"),
    "son_harcama_tl": ("Son Dönem Harcama", "TL"),
    "ilk_harcama_tl": ("İlk Dönem Harcama", "TL"),
    "harcama_degisim_yuzde": ("Harcama Değişimi", "%"),
    "son_frekans": ("Son Frekans", "oran"),
    "ilk_frekans": ("İlk Frekans", "oran"),
    "frekans_degisim": ("Frekans Değişimi", "oran"),
    "son_ctr": ("Son CTR", "%"),
    "ilk_ctr": ("İlk CTR", "%"),
    "ctr_degisim_puan": ("CTR Değişimi", "%"),
    "son_cpa": ("Son CPA", "TL"),
    "ilk_cpa": ("İlk CPA", "TL"),
    "son_cvr": ("Son Dönüşüm Oranı", "%"),
    "net_katki_tl": ("Net Katkı", "TL"),
    "zarardaki_donem": ("Zararda Geçen Dönem", "sayi"),
    "doyum_donemi": ("Frekansın Doyuma Ulaştığı Dönem", "sayi"),
    "zarar_donemi": ("Zarara Geçilen Dönem", "sayi"),
    "harcama_trend_step": ("Harcama Eğilimi (Dönem Başı)", "TL"),
}

# Dimension total -> (label, unit).
DIMENSION_AGGREGATES = {
    "toplam_harcama_tl": ("Harcama", "TL"),
    "toplam_gelir_tl": ("Gelir", "TL"),
    "portfoy_roas": ("ROAS", "oran"),
    "toplam_donusum": ("Dönüşüm", "adet"),
    "kampanya_sayisi": ("Kampanya Sayısı", "sayi"),
}

# Imputation title and detail by target column.
IMPUTATION = {
    "harcama_tl": (
        "Eksik harcama kampanyanın kendi ortancasından tamamlandı",
        "Eksik harcama, aynı kampanyanın diğer dönemlerindeki ortanca değerle dolduruldu.",
    ),
    "gosterim": (
        "Eksik gösterim/tıklama/dönüşüm/gelir değerleri tamamlandı",
        "Eksik gösterim ortanca ile dolduruldu.",
    ),
    "tiklama": ("Eksik tıklama tamamlandı", "Eksik tıklama ortanca ile dolduruldu."),
    "frekans": ("Eksik frekans tamamlandı", "Eksik frekans ortanca ile dolduruldu."),
    "donusum": ("Eksik dönüşüm tamamlandı", "Eksik dönüşüm ortanca ile dolduruldu."),
    "gelir_tl": ("Eksik gelir tamamlandı", "Eksik gelir ortanca ile dolduruldu."),
}

# Integrity rule title and detail by code.
INTEGRITY = {
    "CLICKS_EXCEED_IMPRESSIONS": (
        "Tıklama gösterimden fazla",
        "{count} kayıtta tıklama gösterimi aşıyor; ölçüm hatası olmalı.",
    ),
    "CONVERSIONS_EXCEED_CLICKS": (
        "Dönüşüm tıklamadan fazla",
        "{count} kayıtta dönüşüm tıklamadan fazla; atıf penceresi kaymış olabilir.",
    ),
    "NEGATIVE_VALUE": ("Negatif metrik", "{count} kayıtta negatif harcama veya gelir var."),
    "SPEND_WITHOUT_DELIVERY": (
        "Harcama var ama gösterim yok",
        "{count} kayıtta bütçe harcanmış ama hiçbir gösterim kaydedilmemiş.",
    ),
}

# Risk title, narrative and recommendation by code.
RISKS = {
    "AD_FATIGUE": (
        "Kitle yorulması -- kreatif tükendi",
        "Frekans {ilk_frekans:.1f}'den {son_frekans:.1f}'e çıktı: aynı kişilere tekrar tekrar "
        "gösteriliyor. Aynı dönemde CTR %{ilk_ctr:.2f}'den %{son_ctr:.2f}'e, ROAS "
        "{ilk_roas:.2f}'den {son_roas:.2f}'e düştü. Harcama artmaya devam ederken sonuç düşüyor "
        "-- kitle doydu.",
        "Kampanyayı durdurun. Kreatifi yenileyip kitleyi genişletmeden bütçe koymayın; mevcut "
        "haliyle her ek lira daha az geri dönüyor.",
    ),
    "SCALING_INEFFICIENCY": (
        "Verimsiz ölçekleme -- bütçe artıyor, getiri düşüyor",
        "Harcama {ilk_harcama_tl:tl} seviyesinden {son_harcama_tl:tl} seviyesine çıktı "
        "(%{harcama_degisim_yuzde:.0f} artış) ama ROAS {ilk_roas:.2f}'den {son_roas:.2f}'e "
        "geriledi. Bütçe büyüdükçe verim düşüyor: kampanya ölçeklenmeye uygun değil.",
        "Bütçeyi ölçekleme öncesi seviyeye çekin. Ek bütçeyi ROAS'ı yüksek kampanyalara aktarın.",
    ),
    "UNPROFITABLE": (
        "Kampanya para kaybediyor",
        "Son dönem ROAS {son_roas:.2f}: harcanan her 1 TL {son_roas:.2f} TL geri getiriyor. Altı "
        "dönemde toplam net katkı {net_katki_tl:tl}.",
        "Durdurun ya da hedefleme/kreatif tamamen yenilenene kadar bütçeyi minimuma çekin.",
    ),
    "STAR_SCALE_UP": (
        "Yıldız kampanya -- bütçe artırılmalı",
        "ROAS {son_roas:.2f} ve frekans {son_frekans:.1f} -- kitle henüz doymamış. Bu kampanya ek "
        "bütçeyi verimli çevirebilecek durumda; şu an aylık {son_harcama_tl:tl} harcıyor.",
        "Bütçeyi kademeli artırın (%20-30 adımlarla) ve her adımda ROAS ile frekansı izleyin.",
    ),
    "FREQUENCY_SATURATION": (
        "Frekans doyum eşiğinde",
        "Frekans {son_frekans:.1f}'e ulaştı. ROAS henüz sert düşmedi ama aynı kitleye tekrar "
        "gösterim artıyor; önlem alınmazsa yorulma başlar.",
        "Kitleyi genişletin veya kreatif rotasyonu kurun.",
    ),
    "EFFICIENT_GROWTH": (
        "Verimli büyüme -- ölçekleme çalışıyor",
        "Harcama %{harcama_degisim_yuzde:.0f} arttığı halde ROAS {ilk_roas:.2f} -> {son_roas:.2f} "
        "seviyesinde korundu. Ölçekleme verimi bozmadı; mevsimsel talep gerçek.",
        "Bu kampanyaya bütçe aktarımı güvenli; artışı sürdürün.",
    ),
    "LOW_CONVERSION": (
        "Düşük dönüşüm oranı",
        "Dönüşüm oranı %{son_cvr:.2f}: tıklama geliyor ama satışa dönmüyor. CPA {son_cpa:tl}.",
        "Landing sayfası ve ürün-kitle uyumunu gözden geçirin; sorun reklamda olmayabilir.",
    ),
}
