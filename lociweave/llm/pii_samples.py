"""A bounded labelled sample of made-up texts with and without personal information, in five languages.

Sentences are put together from general phrases of letters, forms and notices; numbers follow the published formats of
their countries, a part of them in the ranges that are set aside for fiction; names and streets are drawn or made up from
syllables. No text of any data set goes into it.
"""

from __future__ import annotations

import random
import unicodedata
from collections.abc import Callable

from .pii_spans import DIGIT_WORDS, FAMILY, GIVEN, Names

#: Phrases around a piece ({x}) of each kind. "" stands for the piece alone.
FRAMES = {
    "en": {
        "email": ["E-mail: {x}", "Send your application to {x}.", "You can reach our office via {x} or by post.", "Questions? Write to {x}!", "<{x}> wrote:", "For refunds contact {x} within a week.", "Her address is {x}, if I remember rightly.", "({x})", "{x}", "From: {x}"],
        "phone": ["Phone: {x}", "Tel {x}", "Please ring {x} to book a table.", "You can reach me on {x} at any time.", "Our new number is {x}.", "Mobile {x}, fax on request.", "Call us at {x} before noon.", "Call before nine {x}.", "Call after seven {x}, please.", "Dial {x} and ask for the office.", "The line {x} has been cut off.", "Text me: {x}", "Our receptionist answers on {x} on weekdays.", "The number {x} is no longer in use.", "The number, {x}, was printed wrong.", "({x})", "{x}"],
        "id_number": ["Her passport number is {x}.", "the number of the card, {x}, was false", "His insurance number: {x}", "Passport no. {x}", "National insurance number: {x}", "My social security number is {x}.", "Tax ID: {x}", "The applicant's identity number {x} was checked.", "ID card {x}, issued last year.", "Driving licence {x}", "Please quote your personal number {x} on the form.", "SSN {x}", "Identification no.: {x}", "taxpayer {x}"],
        "street_address": ["Address: {x}", "She lives at {x}.", "Please send the letter to {x}.", "Our shop at {x} is open daily.", "We have moved to {x}.", "Deliver the chairs to {x} on Monday.", "The meeting takes place at {x} in the hall.", "Visit us: {x}", "{x}", "He was born at {x}, and died there.", "The house at {x} burned down.", "Goods are stored at {x} for now.", "We met at {x} I think."],
        "person_name": ["{x} {v} the {v}.", "{W} {v} {x} {v} {v}.", "{v} {v} {x}.", "{W}, {x}", "All the best, {x}", "{W} {x} {v} {v}.", "Dear {x},", "Mr {x} will see you now.", "Mrs. {x} and her dog", "Yours sincerely, {x}", "The contract was signed by {x}.", "Contact person: {x}", "{x} said that the road was closed.", "{x} wrote the report.", "Thanks to {x} for the photographs.", "According to {x}, it never happened.", "Witness: {x}", "I spoke with {x} yesterday.", "Dr {x} examined the patient.", "Name: {x}", "{x} lives in the village.", "Present were {x} and the clerk.", "The prize went to {x}.", "a letter from {x}", "Author: {x}", "The accused, {x}, denied everything.", "({x})", "for {x}"],
    },
    "de": {
        "email": ["E-Mail: {x}", "Bewerbungen bitte an {x}.", "Sie erreichen unser Büro über {x}.", "Fragen? Schreiben Sie an {x}!", "Seine Anschrift lautet {x}, glaube ich.", "({x})", "Von: {x}"],
        "phone": ["Telefon: {x}", "Tel. {x}", "Mobil {x}, Fax auf Anfrage.", "Bitte {x} anrufen.", "Unsere neue Nummer lautet {x}.", "Sie erreichen mich unter {x} jederzeit.", "Rufen Sie ab neun {x} an.", "Rufen Sie nach sieben {x} an.", "Bitte um acht {x} wählen.", "Wählen Sie {x} und fragen Sie nach dem Amt.", "Der Anschluss {x} ist gesperrt.", "Die Zentrale ist werktags unter {x} besetzt.", "Die Nummer {x} gilt nicht mehr.", "Die Nummer, {x}, war falsch gedruckt.", "{x}", "({x})"],
        "id_number": ["Die Nummer ihres Ausweises ist {x}.", "Passnummer: {x}", "Der Ausweis mit der Nummer {x} fehlt.", "Reisepass Nr. {x}", "Personalausweis: {x}", "Steuernummer {x}", "Meine Sozialversicherungsnummer ist {x}.", "Die Ausweisnummer {x} wurde geprüft.", "Führerschein {x}", "Bitte geben Sie Ihre Personalnummer {x} an.", "Steuer-Identifikationsnummer: {x}"],
        "street_address": ["Anschrift: {x}", "Sie wohnt in der Nähe, {x}.", "Bitte den Brief an {x} senden.", "Unser Laden, {x}, ist täglich geöffnet.", "Wir sind umgezogen: {x}", "Die Stühle gehen an {x} am Montag.", "Die Sitzung findet statt: {x} im Saal.", "Besuchen Sie uns: {x}", "Das Haus {x} ist abgebrannt.", "{x}", "Er wurde nach {x} versetzt."],
        "person_name": ["{x} {v} das {v}.", "{W} {v} {x} {v} {v}.", "{v} {v} {x}.", "{W}, {x}", "Alles Gute, {x}", "{W} {x} {v} {v}.", "Sehr geehrter Herr {x},", "Frau {x} ist heute nicht da.", "Mit freundlichen Grüßen {x}", "Der Vertrag wurde von {x} unterschrieben.", "Ansprechpartner: {x}", "{x} sagte, die Straße sei gesperrt.", "{x} schrieb den Bericht.", "Dank an {x} für die Bilder.", "Laut {x} stimmt das nicht.", "Zeuge: {x}", "Ich habe gestern mit {x} gesprochen.", "Dr. {x} untersuchte den Kranken.", "Name: {x}", "{x} wohnt im Dorf.", "Anwesend waren {x} und der Schreiber.", "ein Brief von {x}", "({x})", "für {x}"],
    },
    "fr": {
        "email": ["Courriel : {x}", "Envoyez votre dossier à {x}.", "Vous pouvez nous joindre par {x}.", "Une question ? Écrivez à {x} !", "({x})", "De : {x}"],
        "phone": ["Téléphone : {x}", "Tél. {x}", "Merci d'appeler le {x} pour réserver.", "Notre nouveau numéro est le {x}.", "Portable {x}, fax sur demande.", "Appelez avant neuf heures {x}.", "Appelez après huit heures {x}.", "Composez le {x} et demandez le bureau.", "La ligne {x} est coupée.", "Le standard répond au {x} en semaine.", "Le numéro {x} n'est plus attribué.", "Le numéro, {x}, était faux.", "{x}", "On me joint au {x} à toute heure.", "({x})"],
        "id_number": ["Le numéro de sa carte d'identité est {x}.", "un permis au numéro {x}", "Numéro de passeport : {x}", "Passeport n° {x}", "Numéro de sécurité sociale : {x}", "Mon numéro fiscal est {x}.", "La pièce d'identité {x} a été vérifiée.", "Permis de conduire {x}", "Indiquez votre numéro personnel {x} sur le formulaire.", "NIR {x}"],
        "street_address": ["Adresse : {x}", "Elle habite {x}.", "Envoyez la lettre au {x}.", "Notre magasin du {x} est ouvert.", "Nous avons déménagé : {x}", "Livrez les chaises au {x} lundi.", "La réunion a lieu au {x} dans la salle.", "{x}", "La maison du {x} a brûlé.", "Elle travaille au {x} à côté.", "Venez nous voir : {x}"],
        "person_name": ["{x} {v} le {v}.", "{W} {v} {x} {v} {v}.", "{v} {v} {x}.", "{W}, {x}", "Amicalement, {x}", "{W} {x} {v} {v}.", "Cher Monsieur {x},", "Mme {x} est absente.", "Cordialement, {x}", "Le contrat a été signé par {x}.", "Contact : {x}", "{x} a dit que la route était fermée.", "{x} a écrit le rapport.", "Merci à {x} pour les photos.", "Selon {x}, c'est faux.", "Témoin : {x}", "J'ai parlé avec {x} hier.", "Le docteur {x} a vu le malade.", "Nom : {x}", "{x} habite au village.", "une lettre de {x}", "({x})", "pour {x}"],
    },
    "es": {
        "email": ["Correo: {x}", "Envíe su solicitud a {x}.", "Puede escribirnos a {x}.", "¿Preguntas? Escriba a {x}.", "({x})", "De: {x}"],
        "phone": ["Teléfono: {x}", "Tel. {x}", "Llame al {x} para reservar.", "Nuestro nuevo número es el {x}.", "Móvil {x}, fax a petición.", "Llame antes de las nueve {x}.", "Llame después de las ocho {x}.", "Marque el {x} y pregunte por la oficina.", "La línea {x} está cortada.", "La centralita responde en el {x} entre semana.", "El número {x} ya no existe.", "El número, {x}, estaba mal.", "{x}", "Me encuentra en el {x} a cualquier hora.", "({x})"],
        "id_number": ["El número de su carné es {x}.", "un permiso con número {x}", "Número de pasaporte: {x}", "Pasaporte n.º {x}", "DNI {x}", "NIE: {x}", "Mi número de la seguridad social es {x}.", "Se comprobó el documento de identidad {x}.", "NIF {x}", "Indique su número personal {x} en el formulario.", "Permiso de conducir {x}"],
        "street_address": ["Dirección: {x}", "Ella vive en {x}.", "Mande la carta a {x}.", "Nuestra tienda de {x} está abierta.", "Nos hemos mudado a {x}.", "Lleve las sillas a {x} el lunes.", "La reunión es en {x} en la sala.", "{x}", "Se quemó la casa de {x}.", "Trabaja en {x} y vive cerca.", "La oficina de {x} a la izquierda.", "Dejan los paquetes en {x} o en el bar.", "Visítenos: {x}"],
        "person_name": ["{x} {v} el {v}.", "{W} {v} {x} {v} {v}.", "{v} {v} {x}.", "{W}, {x}", "Abrazos, {x}", "{W} {x} {v} {v}.", "Estimado señor {x}:", "La Sra. {x} no está.", "Atentamente, {x}", "El contrato lo firmó {x}.", "Contacto: {x}", "{x} dijo que la calle estaba cerrada.", "{x} escribió el informe.", "Gracias a {x} por las fotos.", "Según {x}, no es cierto.", "Testigo: {x}", "Ayer hablé con {x} en el mercado.", "El doctor {x} vio al enfermo.", "Nombre: {x}", "{x} vive en el pueblo.", "una carta de {x}", "({x})", "para {x}"],
    },
    "ru": {
        "email": ["Эл. почта: {x}", "Заявки отправляйте на {x}.", "Пишите нам: {x}", "Вопросы? Адрес {x}", "({x})", "От: {x}"],
        "phone": ["Телефон: {x}", "Тел. {x}", "Позвоните по номеру {x}, чтобы заказать стол.", "Наш новый номер {x}.", "Моб. {x}, факс по запросу.", "Звоните до девяти {x}.", "Звоните после восьми {x}.", "Наберите {x} и спросите контору.", "Линия {x} отключена.", "Диспетчер отвечает по {x} в будни.", "Номер {x} больше не действует.", "Номер, {x}, был напечатан неверно.", "{x}", "({x})"],
        "id_number": ["Номер её паспорта {x}.", "права с номером {x}", "Номер полиса: страховой {x}", "Паспорт {x}", "СНИЛС {x}", "ИНН: {x}", "Мой страховой номер {x}.", "Удостоверение личности {x} проверено.", "Водительское удостоверение {x}", "Укажите личный номер {x} в анкете."],
        "street_address": ["Адрес: {x}", "Она живёт: {x}.", "Письмо отправьте сюда: {x}.", "Наш магазин, {x}, открыт.", "Мы переехали: {x}", "Стулья везите на {x} в понедельник.", "Собрание пройдёт: {x} в зале.", "{x}", "Сгорел дом: {x}.", "Контора: {x} и склад рядом.", "Склад {x} в центре.", "Ждём вас: {x} с девяти.", "Приходите на {x} к обеду."],
        "person_name": ["{x} {v} {v}.", "{W} {v} {x} {v} {v}.", "{v} {v} {x}.", "{W}, {x}", "Обнимаю, {x}", "{W} {x} {v} {v}.", "Уважаемый господин {x}!", "Г-жа {x} сегодня отсутствует.", "С уважением, {x}", "Договор подписал {x}.", "Контакт: {x}", "{x} сказал, что дорога закрыта.", "{x} написал отчёт.", "Спасибо {x} за снимки.", "По словам {x}, это не так.", "Свидетель: {x}", "Вчера говорили: {x} и сосед.", "Доктор {x} осмотрел больного.", "Имя: {x}", "{x} живёт в деревне.", "письмо от {x}", "({x})", "для {x}"],
    },
}
#: Sentences without personal information, some of them close to it. {n}: a number that names a thing, {f} {g}: a family or given
#: name alone, {w}: a street without a number, {c}: two words with capitals that name a thing or place,
#: {l} {L}: a word that could be a name, {v} {W}: a word, {d}: digits.
PLAIN = {
    "en": ["{W} {n}", "{W} {n} {v} {v}.", "{v} {W} {n} {v}.", "{W}: {n}", "{v} {n} {v}", "{d}{d}{d} {v} {v} {w}.", "{W} {c}", "{v} {c} {v}.", "Order {n} was shipped.", "Invoice no. {n} is overdue.", "Serial number {n}, model {d}.", "Ticket {n}", "Version {d}.{d}.{d} fixes the crash.", "Tracking code {n}", "The parcel {n} weighs {d}.{d} kg.", "Open from {d}:{d}{d} to {d}:{d}{d}.", "On {d}/{d}/20{d}{d} it rained.", "Pages {d}{d} to {d}{d}{d}.", "{d}{d}.{d}{d}{d}{d}, {d}{d}.{d}{d}{d}{d}", "In 19{d}{d} there were {d} {d}{d}{d} {d}{d}{d} people.", "The {f} method is well known.", "the {f} bridge over the river", "{g} is a nice name.", "They walked along {w} in the rain.", "{w} is closed to traffic.", "We visited {c} last summer.", "The {c} opens in spring.", "{c} won the cup.", "Follow @{u} for news.", "See chapter {d}, section {d}.", "It costs {d}{d}.{d}{d} pounds.", "at the corner, in the yard, by the gate", "one two three four", "On Monday, in March, the School Board met.", "Will you mark the page in May?", "Thanks to {c} for the grant.", "According to {c}, prices rose.", "Lot {n}, part {n}", "ISBN {n}", "at ten dot was the answer", "The {f} family and {g} came.", "Room {d}{d}{d}, second floor", "Dear Sir or Madam,", "Size {d}{d} x {d}{d} x {d}{d}", "A letter from {c} arrived.", "Tickets for {c} are sold out.", "with {c} by {c}", "({c})", "the {f} Society", "{c} wrote to the council.", "In {c}, {f} Street is closed.", "{c}", "from {c} to {c}", "The {c} {c} opens today.", "a {l} {v} and the {v}", "The {v} {l} was {v}.", "{L} {v} is good for you.", "{v} {l} {v}", "by the {l} {v} of the {v}", "She said {l} {v} to us.", "for {l} {v}, with {v} {l}"],
    "de": ["{W} {n}", "{W} {n} {v} {v}.", "{v} {W} {n} {v}.", "{W}: {n}", "{v} {n} {v}", "{d}{d}{d} {v} {v} {w}.", "{W} {c}", "{v} {c} {v}.", "Bestellung {n} wurde versandt.", "Rechnung Nr. {n} ist fällig.", "Seriennummer {n}, Modell {d}.", "Vorgang {n}", "Fassung {d}.{d}.{d} behebt den Fehler.", "Sendung {n} wiegt {d},{d} kg.", "Geöffnet von {d}:{d}{d} bis {d}{d} Uhr.", "Am {d}.{d}.20{d}{d} regnete es.", "Seiten {d}{d} bis {d}{d}{d}.", "{d}{d},{d}{d}{d}{d} Nord, {d}{d},{d}{d} Ost", "Im Jahr 19{d}{d} lebten dort {d} {d}{d}{d} Menschen.", "Das {f}-Verfahren ist bekannt.", "die {f}-Brücke über den Fluss", "{g} ist ein schöner Name.", "Sie gingen im Regen durch {w}.", "{w} ist gesperrt.", "Im Sommer waren wir in {c}.", "{c} gewann den Pokal.", "Siehe Kapitel {d}, Abschnitt {d}.", "Das kostet {d}{d},{d}{d} Euro.", "eins zwei drei vier", "Am Montag im März tagte der Rat.", "Laut {c} stiegen die Preise.", "Charge {n}, Teil {n}", "Zimmer {d}{d}{d}, zweiter Stock", "Sehr geehrte Damen und Herren,", "Im Hof standen {d} Räder, am Ufer {d} Boote.", "Guten Tag, Liebe Gäste", "Ein Brief von {c} kam an.", "mit {c} für {c}", "({c})", "{c} schrieb an den Rat.", "{c}", "von {c} nach {c}", "Der {c} {c} ist offen.", "Neue Regeln gelten in {c}.", "ein {l} {v} und das {v}", "Der {v} {l} war {v}.", "{L} {v} ist gut.", "{v} {l} {v}", "Der {L} {v} an der {v}.", "mit {l} {v}, von {v} {l}"],
    "fr": ["{W} {n}", "{W} {n} {v} {v}.", "{v} {W} {n} {v}.", "{W}: {n}", "{v} {n} {v}", "{d}{d}{d} {v} {v} {w}.", "{W} {c}", "{v} {c} {v}.", "La commande {n} est partie.", "Facture n° {n} à payer.", "Numéro de série {n}, modèle {d}.", "Dossier {n}", "La version {d}.{d}.{d} corrige l'erreur.", "Le colis {n} pèse {d},{d} kg.", "Ouvert de {d}h{d}{d} à {d}{d}h.", "Le {d}/{d}/20{d}{d} il a plu.", "Pages {d}{d} à {d}{d}{d}.", "En 19{d}{d} il y avait {d} {d}{d}{d} habitants.", "La méthode {f} est connue.", "le pont {f} sur la rivière", "{g} est un joli prénom.", "Ils marchaient dans {w} sous la pluie.", "{w} est fermée.", "L'été nous étions à {c}.", "{c} a gagné la coupe.", "Voir chapitre {d}, section {d}.", "Cela coûte {d}{d},{d}{d} euros.", "un deux trois quatre", "Selon {c}, les prix montent.", "Lot {n}, pièce {n}", "Chambre {d}{d}{d}, deuxième étage", "Madame, Monsieur,", "Une lettre de {c} est arrivée.", "avec {c} pour {c}", "({c})", "{c} a écrit au conseil.", "{c}", "La {c} {c} est ouverte.", "un {l} {v} et le {v}", "Le {v} {l} était {v}.", "{L} {v} est bon.", "{v} {l} {v}", "par {l} {v}, avec {v} {l}"],
    "es": ["{W} {n}", "{W} {n} {v} {v}.", "{v} {W} {n} {v}.", "{W}: {n}", "{v} {n} {v}", "{d}{d}{d} {v} {v} {w}.", "{W} {c}", "{v} {c} {v}.", "El pedido {n} ha salido.", "Factura n.º {n} por pagar.", "Número de serie {n}, modelo {d}.", "Expediente {n}", "La versión {d}.{d}.{d} corrige el error.", "El paquete {n} pesa {d},{d} kg.", "Abierto de {d}:{d}{d} a {d}{d} horas.", "El {d}/{d}/20{d}{d} llovió.", "Páginas {d}{d} a {d}{d}{d}.", "En 19{d}{d} había {d}.{d}{d}{d} habitantes.", "El método {f} es conocido.", "el puente {f} sobre el río", "{g} es un nombre bonito.", "Caminaban por {w} bajo la lluvia.", "{w} está cerrada.", "En verano estuvimos en {c}.", "{c} ganó la copa.", "Véase capítulo {d}, sección {d}.", "Cuesta {d}{d},{d}{d} euros.", "uno dos tres cuatro", "Según {c}, suben los precios.", "Lote {n}, pieza {n}", "Habitación {d}{d}{d}, segundo piso", "Estimados señores:", "Llegó una carta de {c}.", "con {c} para {c}", "({c})", "{c} escribió al consejo.", "{c}", "El {c} {c} abre hoy.", "un {l} {v} y el {v}", "El {v} {l} era {v}.", "{L} {v} es bueno.", "{v} {l} {v}", "por {l} {v}, con {v} {l}"],
    "ru": ["{W} {n}", "{W} {n} {v} {v}.", "{v} {W} {n} {v}.", "{W}: {n}", "{v} {n} {v}", "{d}{d}{d} {v} {v} {w}.", "{W} {c}", "{v} {c} {v}.", "Заказ {n} отправлен.", "Счёт № {n} к оплате.", "Серийный номер {n}, модель {d}.", "Дело {n}", "Версия {d}.{d}.{d} исправляет ошибку.", "Посылка {n} весит {d},{d} кг.", "Открыто с {d}:{d}{d} до {d}{d} часов.", "{d}.{d}.20{d}{d} шёл дождь.", "Страницы {d}{d}–{d}{d}{d}.", "В 19{d}{d} году жило {d} {d}{d}{d} человек.", "Метод {f} известен.", "мост {f} через реку", "{g} — красивое имя.", "Они шли по {w} под дождём.", "{w} закрыта.", "Летом мы были в {c}.", "{c} выиграла кубок.", "См. главу {d}, раздел {d}.", "Это стоит {d}{d},{d}{d} рублей.", "раз два три четыре", "По данным {c}, цены растут.", "Партия {n}, деталь {n}", "Комната {d}{d}{d}, второй этаж", "Уважаемые гости!", "Пришло письмо от {c}.", "для {c} от {c}", "({c})", "{c} написал совету.", "{c}", "Новый {c} открыт.", "и {l} {v} или {v}", "Этот {v} {l} был {v}.", "{L} {v} хорош.", "{v} {l} {v}", "для {l} {v}, от {v} {l}"],
}
#: Numbers that name things. 0 stands for any digit, ? for any capital, all else for itself.
THINGS = ["00000000", "0000000", "000000000", "0000000000", "00000000000", "000-000-000", "0000-0000", "??-00000", "?0000000", "000000-00", "000 000 000", "0000000000000", "978-0-00-000000-0", "?00-0000-00", "00000000000-00", "000.000.000", "???000000"]
#: Published formats of telephone numbers; the first of each list are in ranges set aside for fiction. 0 stands for any digit, o for a zero, a 9 before two of them for 2 to 9.
PHONES = {
    "en": [["900-555-o100", "+1 900 555 o100", "(900) 555-o100", "1-900-555-o100", "900.555.o100", "900555o100", "o20 7946 0000", "+44 20 7946 0000", "(o20) 7946-0000", "o7700 900000", "o114 496 0000"], ["900-900-0000", "(900) 900-0000", "+1 900 900 0000", "900.900.0000", "+1-900-900-0000", "1 900 900 0000", "o20 0000 0000", "+44 20 0000 0000", "+44 (o)20 0000 0000", "o7000 000000", "+44 7000 000000", "o7000 000 000", "oo00 000 0000", "o1000 000000"]],
    "de": [["o30 23125 000", "o30/23125-000", "(o30) 23125 000", "+49 (o)30 23125-000", "+49 30 23125000", "oo49 30 23125 000", "o221 4710 000", "o171 3920000"], ["o30 0000000", "oo00 0000000", "oo00/000000", "+49 000 0000000", "+49 (o)000 000000", "oo49 00 0000000", "o100 0000000", "o1000 000000", "(o0000) 00000", "o89-000000", "+49 100 00000000"]],
    "fr": [["o1 99 00 00 00", "o1.99.00.00.00", "o1-99-00-00-00", "o199000000", "+33 1 99 00 00 00", "oo33 1 99000000", "o6 39 98 00 00"], ["oo 00 00 00 00", "oo.00.00.00.00", "+33 0 00 00 00 00", "+33 (o)0 00 00 00 00", "oo33 0 00 00 00 00", "o600000000", "o6-00-00-00-00"]],
    "es": [["900 000 000", "+34 900 000 000", "512 00 00 00", "(+34) 512000000", "512-000-000"], ["600 000 000", "600 00 00 00", "900000000", "+34 600 000 000", "oo34 600 00 00 00", "91 000 00 00", "+34 91 000 00 00", "600-000-000"]],
    "ru": [["+7 (095) 555-00-00", "+7095555-0000", "8 095 555 00 00", "8-095-555-0000", "+7 900 555-00-00"], ["8 (900) 000-00-00", "+7 900 000-00-00", "8 900 000 00 00", "+79000000000", "8-900-000-0000", "8(900)0000000", "8 9000 00-00-00"]],
}
#: Published formats of identity, tax and insurance numbers, the first of each list again in ranges that are never given out.
IDS = {
    "en": [["666-00-0000", "000-00-0000", "900-00-0000", "666 00 0000", "666000000", "QQ 00 00 00 C", "QQ000000A"], ["000-00-0000", "000000000", "?? 00 00 00 ?", "??000000?", "00-0000000", "?00000000", "0000000000", "000000000 ", "?0000000"]],
    "de": [["00 000 000 000", "00000000000", "00 000000 ? 000"], ["00 000 000 000", "00000000000", "00 000000 ? 000", "?00?00?00", "?000000000", "000/000/00000", "00/000/00000", "00000000?000", "?00000000?", "??0000000"]],
    "fr": [["8 00 00 00 000 000 00", "800000000000000", "8000000000000 / 00"], ["1 00 00 00 000 000 00", "2 00 00 00 000 000", "100000000000000", "200000000000000", "00??00000", "00 00 000 000 000", "0000000000000", "?0?0?0?00"]],
    "es": [["00000000-I", "00000000U", "00.000.000 O", "X-0000000-U", "00/00000000/00"], ["00000000?", "00000000-?", "00.000.000-?", "X0000000?", "Y-0000000-?", "???000000", "00 0000000000", "00/00000000/00", "00.000.000 ?"]],
    "ru": [["000-000-000 00", "0000 000000"], ["0000 000000", "00 00 000000", "000-000-000 00", "000000000000", "0000000000", "00 0000000", "00000000000", "0000 № 000000"]],
}
#: Syllables and endings of made-up names. Fixed values.
SYLLABLES = {"x": ["ba", "be", "ca", "da", "de", "fa", "ga", "ha", "jo", "ka", "la", "le", "li", "lo", "ma", "mi", "mo", "na", "ne", "no", "pa", "ra", "ri", "ro", "sa", "se", "ta", "te", "ti", "to", "va", "ve", "wi", "zo", "al", "an", "ar", "el", "en", "er", "in", "or", "ul"], "ru": ["ба", "ва", "ге", "да", "до", "жи", "за", "ка", "ко", "ла", "ле", "ма", "ми", "на", "но", "па", "ра", "ро", "са", "та", "ти", "ха", "че", "ша", "ан", "ер", "ол"]}
ENDS = {"given": {"x": ["a", "ia", "an", "en", "o", "el", "us", "ine", "ette", "in"], "ru": ["а", "ия", "ей", "ан", "ил"]}, "family": {"x": ["son", "mann", "berg", "ez", "ley", "ton", "er", "ski", "ard", "eau", "feld", "ini", "well", "sen", "ford", "stein"], "ru": ["ов", "ова", "ев", "ева", "ин", "ина", "енко", "ский"]}}
WORDS = {"en": "old new good small bread house river road water tree dog is was and of with not more light stone".split(), "de": "alt neu gut klein brot haus fluss weg wasser baum hund ist war und von mit nicht mehr licht stein".split(), "fr": "vieux neuf bon petit pain maison fleuve eau arbre chien est et de avec pas plus pierre".split(), "es": "viejo nuevo bueno pequeño pan casa agua perro es era y de con no más luz piedra".split(), "ru": "старый новый добрый малый хлеб дом вода пёс был и с не свет камень".split()}
#: Parts of street names.
STREETS = {
    "en": (["Street", "Road", "Lane", "Avenue", "Terrace", "Way", "Close", "Drive", "Court", "Square", "Crescent", "Gardens", "Row", "Hill", "Place", "Boulevard", "St", "Rd", "Ave", "Blvd", "Dr", "Ln", "St.", "Ave.", "Blvd."], ["Oak", "Elm", "Station", "Park", "Victoria", "Queen's", "Green", "North", "Lower", "St. Mary", "Bridge", "Washington", "Maple", "Church", "King", "Orchard"]),
    "de": (["straße", "str.", "weg", "gasse", "allee", "platz", "ufer", "ring", "damm", "steig"], ["Garten", "Schiller", "Kirch", "Bahnhof", "Rosen", "Wald", "Schul", "Berg", "Buchen", "Dorf", "Ring", "Wiesen", "Friedrich", "Burg"]),
    "fr": (["rue", "avenue", "boulevard", "place", "chemin", "impasse", "allée", "quai", "cours", "route"], ["Pasteur", "de Paris", "des Lilas", "du Marché", "de la Liberté", "Victor Hugo", "de l'Hôpital", "des Écoles", "du Bac", "Saint-Martin", "des Grands Champs", "de la Petite Fontaine"]),
    "es": (["Calle", "Avenida", "Paseo", "Plaza", "Camino", "Ronda", "C/", "Avda.", "Travesía"], ["Mayor", "de Toledo", "del Prado", "San Juan", "de la Cruz", "de las Flores", "Real", "de los Reyes", "Goya", "del Río Verde", "Nueva"]),
    "ru": (["ул.", "улица", "проспект", "пр.", "пер.", "переулок", "наб.", "бульвар", "шоссе", "площадь"], ["Ленина", "Мира", "Садовая", "Пушкина", "Зелёная", "Победы", "Лесная", "Школьная", "Новая", "Красных Зорь"]),
}
PLACES = {"x": ["City Hall", "Green Valley", "North Harbour", "Central Station", "Red Lion", "Royal Society", "Old Bridge", "Market Square", "Village Council", "New Orchard", "Saint Andrews", "Grand Hotel", "Golden Gate", "River Trust"], "ru": ["Красная Площадь", "Нижний Новгород", "Большой Театр", "Городской Совет", "Новая Ладога"]}
TOWNS = {"en": "{t} {z}", "de": "{z} {t}", "fr": "{z} {t}", "es": "{z} {t}", "ru": "г. {t}"}
DOMAINS = ["example.com", "example.org", "mail.example.net", "my-shop.example", "univ.example.edu", "firma.test", "post.invalid"]
ENDINGS = ["com", "org", "net", "de", "fr", "es", "ru", "co.uk", "info", "example", "test", "gov.uk"]


def digits(r: random.Random, pattern: str) -> str:
    """0: any digit (a first one stays), o: a zero, 9: 2 to 9 at the head of a group, ?: any capital."""
    out = []
    for i, c in enumerate(pattern):
        out.append(r.choice("0123456789") if c == "0" and i else r.choice("23456789") if c == "9" and (i == 0 or not pattern[i - 1].isdigit()) and pattern[i + 1 : i + 3] == "00" else r.choice("ABCDEFGHJKLMNPRSTWXYZ") if c == "?" else "0" if c == "o" else c)
    return "".join(out)


def number(r: random.Random, formats: list[list[str]]) -> str:
    pattern = r.choice(formats[0] if r.random() < 0.35 else formats[1])
    if formats in IDS.values():
        # Any first digit, but for those that belong to the format.
        pattern = (r.choice("0123456789") if pattern[0] == "0" and r.random() < 0.8 else pattern[0]) + pattern[1:]
    return digits(r, pattern).strip()


def made_name(r: random.Random, names: Names, part: str, pool: list[str], lang: str) -> str:
    """A known name, a common one, one made like the known ones, or one made of syllables."""
    k = r.random()
    if k < 0.3 and pool:
        return r.choice(pool)
    if k < 0.55:
        common = [n for n in (GIVEN if part == "given" else FAMILY) if (n[0] > "Ͽ") == (lang == "ru")]
        return r.choice(common)
    if k < 0.8 and names.starts:
        starts, ends = sorted(s for s in names.starts if len(s) > 2), sorted(e for e in names.ends[part] if len(e) > 2)
        if starts and ends:
            word = r.choice(starts) + r.choice(ends)
            return "-".join(x[:1].upper() + x[1:] for x in word.split("-"))
    own = "ru" if lang == "ru" else "x"
    return ("".join(r.choice(SYLLABLES[own]) for _ in range(r.choice((1, 2, 2)))) + r.choice(ENDS[part][own])).capitalize()


def word(r: random.Random, lang: str) -> str:
    """A small word or one of syllables, in small letters."""
    return r.choice(WORDS[lang]) if r.random() < 0.5 else "".join(r.choice(SYLLABLES["ru" if lang == "ru" else "x"]) for _ in range(r.choice((1, 2, 2, 3))))


def street(r: random.Random, lang: str) -> str:
    kinds, stems = STREETS[lang]
    kind, stem = r.choice(kinds), r.choice(stems)
    if r.random() < 0.5:
        stem = ("".join(r.choice(SYLLABLES["ru" if lang == "ru" else "x"]) for _ in range(r.choice((2, 3)))) + r.choice(["", "", "n", "s"] if lang != "ru" else ["ная", "ского"])).capitalize()
    if lang == "de":
        k = r.random()
        if k < 0.55:
            return f"{stem}{kind}"
        return r.choice([f"{r.choice(['Lange', 'Neue', 'Alte', 'Hohe'])} {r.choice(['Straße', 'Str.', 'Allee', 'Gasse'])}", f"{r.choice(['Am', 'Im', 'Zum', 'An der', 'Auf dem', 'Unter den'])} {r.choice(['', 'Alten ', 'Neuen '])}{stem}", f"{r.choice(['Platz', 'Straße'])} {r.choice(['der', 'des'])} {stem}", f"{stem}-{kind.capitalize()}" if kind != "str." else f"{stem}-Str."])
    if lang == "en":
        return f"{r.choice(['Old ', 'Upper ', '', '', ''])}{stem} {kind}"
    if lang == "fr" and " " not in stem and r.random() < 0.3:
        stem = r.choice(["de ", "du ", "des ", "de la "]) + stem
    if lang == "es" and " " not in stem and r.random() < 0.3:
        stem = r.choice(["de ", "del ", "de la "]) + stem
    if lang == "fr" and r.random() < 0.15:
        stem = r.choice(["du Vieux ", "de la Grande ", "du Petit "]) + stem.split()[-1]
    return f"{kind}{'' if kind == 'C/' and r.random() < 0.3 else ' '}{stem}"


def styled(r: random.Random, text: str) -> str:
    """Unusual white space and dashes."""
    k = r.random()
    if k < 0.05:
        return text.replace(" ", "\xa0")
    if k < 0.08:
        return text.replace(" ", "  ", 1)
    if k < 0.1:
        return text.replace(" ", "\n", 1)
    return text.replace("-", "‑") if k < 0.14 else text


def email(r: random.Random, name: Callable[[str], str]) -> str:
    a, b = ("".join(c for c in unicodedata.normalize("NFD", name(p).lower()) if "a" <= c <= "z" or c == "-") or "m" for p in ("given", "family"))
    local = r.choice([f"{a}.{b}", f"{a}-{b}", f"{a[0]}{b}", f"{b}_{r.randrange(99)}", f"{a}+{b[:4]}", f"info{r.randrange(400)}", f"{b}.office", a, f"{a}{r.randrange(1950, 2010)}"])
    host = r.choice([b, "mail", "post", f"{a}-{b}", "shop24", "uni"])
    domain = r.choice(DOMAINS) if r.random() < 0.4 else f"{host}.{r.choice(ENDINGS)}"
    k = r.random()
    if k < 0.55:
        text = f"{local}@{domain}"
    elif k < 0.85:
        text = f"{local}{r.choice([' @ ', '＠', '(at)', ' (at) ', ' [at] ', '&#64;'])}{domain}"
    else:
        text = f"{local} at {domain.replace('.', r.choice([' dot ', '(dot)', ' [dot] ', ' (dot) ']))}"
    return text.upper() if r.random() < 0.08 else text


def address(r: random.Random, lang: str) -> str:
    where, n = street(r, lang), str(r.randrange(1, 250))
    letter = r.choice(["", "", "a", "b", "c"])
    # Long numbers, and letters of all kinds, joined or apart.
    if r.random() < 0.15:
        n = str(r.randrange(250, 10 ** r.randrange(4, 7)))
    if r.random() < 0.2:
        letter = r.choice(["", "", " "]) + (r.choice("абвгдежзик") if lang == "ru" else r.choice("abcdefghkmABCDEFGHKM"))
    flat, k = r.randrange(1, 300), r.random()
    if lang == "en":
        text = f"{n}{letter} {where}"
        text = f"{r.choice(['Flat', 'Unit', 'Apartment'])} {flat}, {text}" if k < 0.2 else f"{text}, {r.choice(['Apt.', 'Apt', 'Suite', 'Flat', 'Unit'])} {flat}" if k < 0.4 else text
        return text.upper() if r.random() < 0.08 and "." not in text else text
    if lang == "de":
        text = f"{where} {r.choice([n + letter, n + letter, n + letter, 'Nr. ' + n, n + '-' + str(int(n) + 2)])}"
        return f"{text}, {r.choice(['Whg.', 'Wohnung'])} {flat}" if k < 0.08 else text
    if lang == "fr":
        return f"{n}{r.choice(['', ' bis', ' ter', '', letter])}{r.choice([' ', ', '])}{where}" + (f", {r.choice(['appt', 'appartement', 'bât.'])} {r.choice([str(flat), 'B'])}" if k < 0.1 else "")
    if lang == "es":
        return f"{where}{r.choice([' ', ', ', ' n.º ', ', n.º '])}{n}{letter if r.random() < 0.4 else ''}" + r.choice(["", "", f", {r.randrange(1, 9)}.º {r.choice('ABCD')}", f", {r.randrange(1, 9)}º izq."])
    return f"{where}{r.choice([' ', ', '])}{n}{letter}" if r.random() < 0.6 else f"{where}, д. {n}" + r.choice(["", f", кв. {flat}"])


def span(r: random.Random, kind: str, lang: str, name: Callable[[str], str], latin: Callable[[str], str] | None = None) -> tuple[str, str]:
    """A span of the kind and what follows it without belonging to it."""
    if kind == "phone":
        formats = PHONES[lang if r.random() < 0.8 else r.choice(list(PHONES))]
        if r.random() < 0.2:
            words = [w for w in DIGIT_WORDS[lang].split("|") if w not in ("oh", "zwo", "нуль")]
            return styled(r, " ".join(words[int(c)] for c in number(r, formats) if c.isdigit())), ""
        ext = f" {r.choice(['ext.', 'ext', 'App.', 'Durchwahl', 'poste', 'доб.', 'x'])} {r.randrange(1, 9999)}" if r.random() < 0.18 else ""
        return styled(r, number(r, formats) + ext), ""
    if kind == "id_number":
        return styled(r, number(r, IDS[lang if r.random() < 0.9 else r.choice(list(IDS))])), ""
    if kind == "email":
        return email(r, latin or name), ""
    if kind == "street_address":
        town = TOWNS[lang].replace("{t}", "".join(r.choice(SYLLABLES["ru" if lang == "ru" else "x"]) for _ in range(3)).capitalize()).replace("{z}", f"{r.randrange(10**5):05}")
        return styled(r, address(r, lang)).replace("‑", "-"), f", {town}" if r.random() < 0.35 else ""
    a, b = name("given"), name("family")
    k, initial = r.random(), r.choice("АБВГДЕИКМН" if lang == "ru" else "ABCDEFGHJKLMNPRST")
    text = f"{a} {b}" if k < 0.5 else f"{b}, {a}" if k < 0.62 else f"{initial}. {b}" if k < 0.76 else f"{a} {initial}. {b}" if k < 0.9 else f"{b}, {initial}." if k < 0.95 else f"{b}, {a} {initial}."
    k = r.random()
    text = text.upper() if k < 0.06 else text.lower() if k < 0.14 and "." not in text else text if k > 0.22 else text.replace(b, b.upper())
    return styled(r, text).replace("‑", "-"), ""


def sample(known: list[tuple[str, str]], size: int, seed: int = 11, frames: dict = FRAMES, plain: dict = PLAIN, named: Callable[[random.Random, str, str], str] | None = None) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """`size` short texts with their true spans (kind, start, end). `named` may give other names (of a part and language)."""
    r = random.Random(seed)
    names = Names.of(known)
    pools = {(p, ru): sorted(n for n, q in known if q == p and n and (n[0] > "Ͽ") == ru) for p in ("given", "family") for ru in (False, True)}
    kinds, out = list(frames["en"]), []

    def fill(lang: str, name: Callable[[str], str]) -> str:
        text = r.choice(plain[lang])
        while "{" in text:
            for key, make in (("{n}", lambda: digits(r, r.choice(THINGS).replace("0", r.choice("123456789"), 1) if r.random() < 0.7 else r.choice(THINGS))), ("{f}", lambda: name("family")), ("{g}", lambda: name("given")), ("{w}", lambda: street(r, lang)), ("{c}", lambda: r.choice(PLACES["ru" if lang == "ru" else "x"]) if r.random() < 0.5 else " ".join("".join(r.choice(SYLLABLES["ru" if lang == "ru" else "x"]) for _ in range(r.choice((2, 3)))).capitalize() for _ in range(2))), ("{u}", lambda: "".join(r.choice(SYLLABLES["x"]) for _ in range(3)) + r.choice(["", "24"])), ("{l}", lambda: name(r.choice(("given", "family"))).lower()), ("{L}", lambda: name(r.choice(("given", "family")))), ("{v}", lambda: word(r, lang)), ("{W}", lambda: word(r, lang).capitalize()), ("{d}", lambda: str(r.randrange(10)))):
                text = text.replace(key, make(), 1)
        return text

    for i in range(size):
        text, true = "", []
        lang = r.choice(list(frames))
        name = lambda part, lang=lang: made_name(r, names, part, pools[part, lang == "ru"] if r.random() < 0.9 else pools[part, False], lang)
        latin = lambda part: made_name(r, names, part, pools[part, False], "en")
        if named:
            latin = lambda part: named(r, part, "en")
            name = lambda part, lang=lang: named(r, part, lang)
        for _ in range(r.randrange(1, 4)):
            if r.random() < 0.45:
                text += fill(lang, name)
            else:
                kind = kinds[i % len(kinds)] if r.random() < 0.6 else r.choice(kinds)
                x, tail = span(r, kind, lang, name, latin)
                frame = r.choice(frames[lang][kind])
                while "{v}" in frame or "{W}" in frame:
                    frame = frame.replace("{v}", word(r, lang), 1).replace("{W}", word(r, lang).capitalize(), 1)
                before, after = frame.split("{x}")
                text += before
                true.append((kind, len(text), len(text) + len(x)))
                text += x + tail + after
            text += r.choice([" ", " ", "\n", "  "])
        out.append((text, true))
    return out
